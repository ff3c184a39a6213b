"""Change-capture analytics on Spark: changelogs, current state, history and schema drift."""

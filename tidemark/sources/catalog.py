"""The relations of a PostgreSQL catalog, read as tables.

classes: oid, relname, relnamespace. namespaces: oid, nspname. attributes: attrelid, attnum, attname, atttypid, atttypmod, attisdropped.
indexes: indrelid, indkey (array), indisprimary. information: table_schema, table_name, table_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.imports import key_column


def relations(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(relation_id, namespace, name) of every relation."""
    named = namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("namespace"))
    return classes.join(named, "relnamespace").select(F.col("oid").alias("relation_id"), "namespace", F.col("relname").alias("name"))


def tables(information: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(schema, table_name, relation_id) of every base table; schema and name must both match its relation."""
    base = information.where("table_type = 'BASE TABLE'").select(F.col("table_schema").alias("namespace"), F.col("table_name").alias("name"))
    return base.join(relations(classes, namespaces), ["namespace", "name"]).select(F.col("namespace").alias("schema"), F.col("name").alias("table_name"), "relation_id")


def columns(attributes: DataFrame) -> DataFrame:
    """Columns of all relations by number, without system columns and dropped ones."""
    return attributes.where("attnum > 0 and not attisdropped").select(F.col("attrelid").alias("relation_id"), "attnum", F.col("attname").alias("name"), F.col("atttypid").alias("type"), F.col("atttypmod").alias("modifier"))


def key_attributes(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(relation_id, name): the columns of each relation's primary key."""
    listed = indexes.where("indisprimary").select(F.col("indrelid").alias("relation_id"), F.explode("indkey").alias("attnum"))
    return listed.join(columns(attributes), ["relation_id", "attnum"]).select("relation_id", "name")


def schemas(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """(relation_id, namespace, name, columns) of every relation, columns in order, modifiers as 0: an import knows none."""
    keys = key_attributes(indexes, attributes).withColumn("key", F.lit(True))
    marked = columns(attributes).join(keys, ["relation_id", "name"], "left")
    column = F.struct("attnum", F.coalesce("key", F.lit(False)).alias("key"), "name", "type", F.lit(0).alias("modifier"))
    listed = marked.groupBy("relation_id").agg(F.sort_array(F.collect_list(column)).alias("columns"))  # at most 1600 columns a table
    plain = F.transform("columns", lambda c: c.dropFields("attnum"))
    return relations(classes, namespaces).join(listed, "relation_id").select("relation_id", "namespace", "name", plain.alias("columns"))


def primary_key(found: DataFrame, namespace: str, name: str) -> str:
    """The single key column of a relation of ``schemas``; an error for none, for several, and for a relation that isn't there."""
    row = found.where((F.col("namespace") == namespace) & (F.col("name") == name)).first()
    if row is None:
        raise LookupError(f"no relation {namespace}.{name}")
    return key_column([(c["name"], c["key"]) for c in row["columns"]])

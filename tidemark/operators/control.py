"""Published tables, subscriptions and their imports as relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.changelog import import_status, rows_processed

NAME = ["schema", "table_name"]


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(schema, table_name, table_type) of the session's catalog."""
    rows = [(t.namespace[0] if t.namespace else "", t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "schema string, table_name string, table_type string")


def base_tables(tables: DataFrame) -> DataFrame:
    return tables.where("table_type not in ('VIEW', 'TEMPORARY')").select(*NAME)


def relation_columns(table: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of a table's columns in order."""
    return [(f.name, f.dataType.simpleString()) for f in table.schema.fields]


def watched(tables: DataFrame, schemas: list[str] | None = None, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Tables to be published: of the schemas, included (all if none is named) and not excluded. Names are exact, as schema.table."""
    ref = F.concat_ws(".", *NAME)
    found = tables if not schemas else tables.where(F.col("schema").isin(schemas))
    found = found.where(ref.isin(includes)) if includes else found
    return found.where(~ref.isin(excludes)) if excludes else found


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables of the left that the right lacks."""
    return left.select(*NAME).distinct().join(right.select(*NAME).distinct(), NAME, "left_anti")


def included(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables of the left that the right has."""
    return left.join(right.select(*NAME).distinct(), NAME, "left_semi")


def reconcile(watched_tables: DataFrame, published: DataFrame) -> DataFrame:
    """(schema, table_name, action): tables to ``add`` to a publication and to ``remove`` from it, found in one pass over both."""
    both = watched_tables.select(*NAME, F.lit(1).alias("w"), F.lit(0).alias("p")).unionByName(published.select(*NAME, F.lit(0).alias("w"), F.lit(1).alias("p")))
    sides = both.groupBy(*NAME).agg(F.max("w").alias("w"), F.max("p").alias("p")).where("w <> p")
    return sides.select(*NAME, F.when(F.col("w") == 1, "add").otherwise("remove").alias("action"))


def add_table(published: DataFrame, schema: str, table_name: str) -> DataFrame:
    new = published.sparkSession.createDataFrame([(schema, table_name)], "schema string, table_name string")
    return published.select(*NAME).unionByName(new).dropDuplicates(NAME)


def remove_table(published: DataFrame, schema: str, table_name: str) -> DataFrame:
    return published.select(*NAME).where(~((F.col("schema") == schema) & (F.col("table_name") == table_name)))


def find_publication(publications: DataFrame, name: str) -> DataFrame:
    return publications.where(F.col("name") == name).limit(1)


def published_tables(publications: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Tables of a publication by name."""
    return publications.where(F.col("name") == name).join(members.withColumnRenamed("publication", "name"), "name").select(*NAME)


def newest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each table and subscription: the last created, of several the one with the least id."""
    order = F.struct("created_at", -F.col("id"))
    rest = [c for c in jobs.columns if c not in (*NAME, "subscription_id")]
    newest = jobs.groupBy("subscription_id", *NAME).agg(F.max_by(F.struct(*rest), order).alias("job"))
    return newest.select("subscription_id", *NAME, "job.*")


def jobs_by_table(jobs: DataFrame) -> DataFrame:
    """(schema, table_name, jobs): the imports of each table, newest first. Control data: a handful a table."""
    job = F.struct("created_at", *[c for c in jobs.columns if c not in (*NAME, "created_at")])
    return jobs.groupBy(*NAME).agg(F.sort_array(F.collect_list(job), asc=False).alias("jobs"))


def search(tables: DataFrame, text: str, distance: int = 2) -> DataFrame:
    """Tables whose name contains a text or is within so many edits of it."""
    name = F.lower("table_name")
    return tables.where(name.contains(text.lower()) | (F.levenshtein(name, F.lit(text.lower())) <= distance))


def table_list(tables: DataFrame, published: DataFrame, jobs: DataFrame, subscription_id: str, schemas: list[str] | None = None) -> DataFrame:
    """Every table with its publication and import status, by schema and name.

    Tables are matched by schema and name both, and only the subscription's own imports count.
    """
    chosen = tables if not schemas else tables.where(F.col("schema").isin(schemas))
    newest = newest_jobs(jobs.where(F.col("subscription_id") == subscription_id)).drop("subscription_id")
    member = published.select(*NAME).distinct().withColumn("is_published", F.lit(True))
    joined = chosen.select(*NAME).join(member, NAME, "left").join(newest, NAME, "left")
    status = import_status(F.col("id"), F.col("expired_at"), F.col("completed_at"), F.col("error"), F.col("cursor"))
    return (
        joined.select(
            *NAME,
            F.when(F.col("is_published"), "active").otherwise("inactive").alias("publication_status"),
            status.alias("import_status"),
            rows_processed(status, F.col("rows_processed_total")).alias("rows_processed_total"),
            F.col("error"),
        )
        .orderBy(*NAME)
    )

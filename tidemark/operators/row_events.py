"""From deliveries of changes and imported rows to what happened to each source row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import image, spec_columns
from ..functions.storage import attach

TABLE = ["namespace", "name"]
ROW = [*TABLE, "row_key"]
#: Events of one row in the order in which they took effect. An imported row shows the state before the changes that have its timestamp.
ORDER = ["ts", "is_change", "lsn", "sequence"]


def key_columns(schema_entries: DataFrame) -> DataFrame:
    """(namespace, name, key_columns, key_type): the key columns of each source table by name, as all of its schema entries mark them.

    A key column is never renamed. ``key_type`` is that of a single key column, null for a composite key. Tables none of whose entries
    marks a key have no row.
    """
    columns = F.explode(F.filter(spec_columns(F.col("spec")), lambda c: c["key"]))
    marked = schema_entries.select(*TABLE, columns.alias("key")).groupBy(*TABLE, F.col("key.name").alias("column")).agg(F.max("key.type").alias("type"))
    found = marked.groupBy(*TABLE).agg(F.sort_array(F.collect_list("column")).alias("key_columns"), F.max("type").alias("key_type"))  # at most 1600 columns a table
    return found.withColumn("key_type", F.when(F.size("key_columns") == 1, F.col("key_type")))


def with_keys(modifications: DataFrame, schema_entries: DataFrame, path: str) -> DataFrame:
    """Modifications with ``key_columns`` and ``key_type`` of their table; the lookup table is kept at ``path``."""
    return attach(modifications, key_columns(schema_entries), path, TABLE, ["file_no", "timestamp", "lsn", "sequence"])


def key_text(json: Column) -> Column:
    """The row key in an image: the value of the key column as text; of a composite key the values of all its columns, as the text of a JSON array. Null if one is null or missing."""
    first = F.try_element_at(image(json), F.get("key_columns", F.lit(0)))
    # One parse of the image for both uses.
    values = F.transform(F.array(image(json)), lambda m: F.transform("key_columns", lambda k: F.try_element_at(m, k)))
    all_ = F.get(values, F.lit(0))
    return F.when(F.size("key_columns") == 1, first).when(~F.exists(all_, lambda v: v.isNull()), F.to_json(all_))


def left_out(keyed: DataFrame) -> DataFrame:
    """(namespace, name, reason, deliveries): how many deliveries ``row_events`` makes no event of, by table: ``no key column``, ``no image`` or ``no key value``."""
    why = F.when(F.col("key_columns").isNull(), "no key column").when(image(F.col("after")).isNull() & image(F.col("before")).isNull(), "no image")
    why = why.when(key_text(F.col("after")).isNull() & key_text(F.col("before")).isNull(), "no key value")
    return keyed.select(*TABLE, why.alias("reason")).where("reason is not null").groupBy(*TABLE, "reason").agg(F.count("*").alias("deliveries"))


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp)


def row_events(keyed: DataFrame, payload: bool = True, extra: list[str] | None = None) -> DataFrame:
    """One row per (delivery, row concerned): (namespace, name, row_key, ts, is_change, lsn, sequence, alive[, after], *extra).

    ``alive`` says whether the row exists after the event; an update that changes the key is the end of the old key's row
    and a state of the new key's. ``ts`` is in microseconds. lsn and sequence of imported rows, and a null sequence, are 0.
    Deliveries that name no row are left out: those with neither image, without a value of each key column, or of a table without
    a key column; ``left_out`` counts them.
    """
    after_key, before_key = key_text(F.col("after")), key_text(F.col("before"))
    ended = F.col("before_key").isNotNull() & ~F.col("before_key").eqNullSafe(F.col("after_key"))
    both = F.array(
        F.when(F.col("after_key").isNotNull(), F.struct(F.col("after_key").alias("row_key"), F.lit(True).alias("alive"))),
        F.when(ended, F.struct(F.col("before_key").alias("row_key"), F.lit(False).alias("alive"))),
    )
    order = [
        micros(F.col("timestamp")).alias("ts"),
        F.col("lsn").isNotNull().cast("int").alias("is_change"),
        F.coalesce("lsn", F.lit(0)).alias("lsn"),
        F.when(F.col("lsn").isNotNull(), F.coalesce("sequence", F.lit(0))).otherwise(F.lit(0)).alias("sequence"),
    ]
    more = extra or []
    held = [*([F.col("after")] if payload else []), *more]
    return (
        keyed.where("key_columns is not null")
        .select(*TABLE, *order, *held, after_key.alias("after_key"), before_key.alias("before_key"))
        .select(*TABLE, *ORDER, *held, F.explode(F.filter(both, lambda e: e.isNotNull())).alias("row"))
        .select(*TABLE, "row.row_key", *ORDER, "row.alive", *([F.when(F.col("row.alive"), F.col("after")).alias("after")] if payload else []), *more)
    )

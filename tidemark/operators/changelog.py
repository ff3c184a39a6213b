"""Decoded messages as a changelog: sequence in the transaction, relation of each row, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.changelog import operation
from ..functions.storage import stored
from .row_events import TABLE
from .segments import carried, segmented

ENTRY = "slot string, position bigint, kind string, timestamp timestamp, namespace string, name string, lsn bigint, sequence bigint, message_type string, spec string, before map<string,string>, after map<string,string>, unchanged array<string>"


def filled(rows: DataFrame, group: list[str], at: str, values: list[str]) -> DataFrame:
    """``rows`` with each of ``values`` that is null replaced by the last one before it that isn't, by ``at`` within ``group``.

    ``at`` is a number that tells the rows of a group apart. A large group is taken in stretches, each of which begins with
    what the earlier ones leave; none that has no earlier value stays null.
    """
    cut, large = segmented(rows, group, at)
    cut = cut.withColumn("_carried", F.lit(False))
    if large:
        # Each stretch leaves its last values; the lag of those, filled in turn, is what the next begins with.
        lasts = [F.max_by(F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("x"))), F.when(F.col(v).isNotNull(), F.col(at))).alias(v) for v in values]
        tails = cut.where("segment >= 0").groupBy(*group, "segment").agg(*lasts)
        earlier = Window.partitionBy(*group).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        heads = tails.select(*group, "segment", *[F.last(v, ignorenulls=True).over(earlier)["x"].alias(v) for v in values])
        cut = cut.unionByName(heads.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy(*group, "segment").orderBy(F.col("_carried").desc(), at).rowsBetween(Window.unboundedPreceding, 0)
    return cut.select(*[c for c in rows.columns if c not in values], *[F.last(v, ignorenulls=True).over(so_far).alias(v) for v in values], "_carried").where("not _carried").select(*rows.columns)


def with_previous(rows: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with the ``values`` (new name: column) of the row before, by ``order`` within ``group``; the first of ``order`` is a number."""
    cut, large = segmented(rows, group, order[0])
    cut = cut.withColumn("_carried", F.lit(False))
    if large:
        heads = carried(cut, group, order, sorted(set(values.values()) | set(order)))
        cut = cut.unionByName(heads.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    by_group = Window.partitionBy(*group, "segment").orderBy(*order)
    return cut.select("*", *[F.lag(c).over(by_group).alias(new) for new, c in values.items()]).where("not _carried").drop("_carried", "segment")


def sequenced(messages: DataFrame) -> DataFrame:
    """Messages (slot, position, message) with the transaction each is in: begin_lsn, commit_us, xid and its sequence there from 1.

    Begin and commit messages are used up. A message outside a transaction is an error. Positions are those of the log and unique in a slot.
    """
    kind = F.col("message.msg_type")
    begin = F.when(kind == "B", F.struct(F.col("position").alias("begin_position"), "message.lsn", "message.timestamp_us", "message.xid"))
    ended = F.when(kind == "C", F.struct(F.lit(None).cast("bigint").alias("begin_position"), "message.lsn", "message.timestamp_us", F.lit(None).cast("bigint").alias("xid")))
    marked = filled(messages.withColumn("begin", F.coalesce(begin, ended)), ["slot"], "position", ["begin"])
    inside = marked.where(~kind.isin("B", "C"))
    checked = inside.withColumn("begin_lsn", F.when(F.col("begin.xid").isNull(), F.raise_error(F.lit("message outside a transaction"))).otherwise(F.col("begin.lsn")))
    in_transaction = Window.partitionBy("slot", F.col("begin.begin_position")).orderBy("position")
    return checked.select("slot", "position", "message", "begin_lsn", F.col("begin.timestamp_us").alias("commit_us"), "begin.xid", F.row_number().over(in_transaction).cast("bigint").alias("sequence"))


def resolved(messages: DataFrame) -> DataFrame:
    """Messages with ``relation``: the newest relation message of theirs before them. A row of a relation never seen is an error."""
    kind = F.col("message.msg_type")
    own = F.when(kind == "R", F.struct("message.namespace", "message.name", "message.columns"))
    with_id = messages.withColumn("relation_id", F.col("message.relation_id")).withColumn("relation", own)
    found = filled(with_id.where("relation_id is not null"), ["slot", "relation_id"], "position", ["relation"])
    return found.withColumn("relation", F.when(kind.isin("I", "U", "D") & F.col("relation").isNull(), F.raise_error(F.lit("row of an unknown relation"))).otherwise(F.col("relation")))


def marshal(columns: Column, cells: Column) -> Column:
    """A row image: cells by column name, null where a cell is null or unchanged. Null if the numbers differ or there is no row."""
    named = F.map_from_entries(F.transform(F.arrays_zip(columns.alias("c"), cells.alias("v")), lambda x: F.struct(x["c"]["name"], x["v"]["value"])))
    return F.when(cells.isNotNull() & (F.size(columns) == F.size(cells)), named)


def unchanged(columns: Column, cells: Column) -> Column:
    """Names of the columns whose value was not sent because it did not change."""
    return F.transform(F.filter(F.arrays_zip(columns.alias("c"), cells.alias("v")), lambda x: x["v"]["type"] == "u"), lambda x: x["c"]["name"])


def entries(messages: DataFrame, path: str | None = None) -> DataFrame:
    """The changelog of decoded messages (slot, position, message): schema and modification entries, in columns of ENTRY.

    Each step reads its input more than once; with ``path`` messages and sequenced messages are stored there in between.

    All entries of a transaction have its final lsn and commit time; ``sequence`` keeps their order. A row whose cells don't
    fit its relation has no image (quarantine these by ``malformed_rows``). Origin and type messages bring no entry.
    """
    keep = (lambda df, name: stored(df, f"{path}/{name}")) if path else (lambda df, name: df)
    found = resolved(keep(sequenced(keep(messages, "messages")), "sequenced")).where(F.col("message.msg_type").isin("R", "I", "U", "D"))
    kind, columns = F.col("message.msg_type"), F.col("relation.columns")
    return found.select(
        "slot", "position",
        F.when(kind == "R", "schema").otherwise("modification").alias("kind"),
        F.timestamp_micros("commit_us").alias("timestamp"),
        "relation.namespace", "relation.name",
        F.col("begin_lsn").alias("lsn"), "sequence",
        kind.alias("message_type"),
        F.when(kind == "R", F.to_json(F.struct(columns.alias("columns")))).alias("spec"),
        marshal(columns, F.col("message.old_row")).alias("before"),
        marshal(columns, F.col("message.row")).alias("after"),
        F.coalesce(unchanged(columns, F.col("message.row")), F.array().cast("array<string>")).alias("unchanged"),
    )


def malformed_rows(changelog: DataFrame) -> DataFrame:
    """Modifications without any image: their cells did not fit their relation."""
    return changelog.where("kind = 'modification' and before is null and after is null")


def merged(stream: DataFrame, imported: DataFrame) -> DataFrame:
    """One changelog of log entries and imported rows, which have no lsn."""
    return stream.unionByName(imported, allowMissingColumns=True)


def raw_changelog(changelog: DataFrame, payload: Column) -> DataFrame:
    """Rows of a raw table: timestamp, lsn, sequence, operation and the payload (after, or else before)."""
    what = operation(F.col("lsn"), F.col("before"), F.col("after"), F.col("message_type") if "message_type" in changelog.columns else None)
    return changelog.select("timestamp", "lsn", "sequence", what.alias("operation"), payload.alias("payload"))


def latest(rows: DataFrame, key: list[str], order: list[str], kept: Column | None = None) -> DataFrame:
    """The last row of each key by ``order`` (largest first by the first column, then the next), and of those the ones ``kept``.

    The row is chosen before the filter, so an ended key has none. Spark limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends one row per map task.
    """
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    first = rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return first if kept is None else first.where(kept)


def batch_result(written: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count and highest lsn of what was written (of each batch, if there are columns that tell them apart): per partition first, then of all."""
    return written.groupBy(*(by or [])).agg(F.count("*").alias("count"), F.max("lsn").alias("lsn"))


def confirmed(changelog: DataFrame) -> DataFrame:
    """The highest position that may be confirmed: that of the last ``ack`` entry, which follows a whole transaction. Null without one."""
    return changelog.where("kind = 'ack'").agg(F.max("lsn").alias("lsn"))


def last_lsn(written: DataFrame, at: str) -> DataFrame:
    """The log position of the last row by ``at`` that has one; the highest of an ordered batch."""
    return written.where("lsn is not null").agg(F.max_by("lsn", at).alias("lsn"))


def route_counts(changelog: DataFrame) -> DataFrame:
    return changelog.groupBy(*TABLE).count()

"""Runs that take exactly what is new or changed since the last successful one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Storage, attach, stored
from .row_events import TABLE, row_events

PARTITION, OFFSET = "subscription_id", "file_no"
RECORD = ["kind", "namespace", "name", "record_key"]
#: Offsets to a bin, in which ranges of offsets meet the offsets that exist.
BIN = 1024
STATES = ["started", "success", "failed", "reverted"]


def runs(sink_runs: DataFrame) -> DataFrame:
    """(subscription_id, run_id, first_file, last_file, state, started_at), a row per run, in its latest state.

    Of states logged at one instant the later in STATES counts. A run whose ``started`` is missing has no start.
    """
    rank = F.coalesce(F.array_position(F.lit(STATES), F.col("state")), F.lit(0))
    return sink_runs.groupBy(PARTITION, "run_id").agg(
        F.max_by("state", F.struct("logged_at", rank)).alias("state"),
        F.min(F.when(F.col("state") == "started", F.col("logged_at"))).alias("started_at"),
        F.min("first_file").alias("first_file"),
        F.max("last_file").alias("last_file"),
    )


def pending_offsets(log: DataFrame, sink_runs: DataFrame) -> DataFrame:
    """(subscription_id, file_no): offsets of the log, per partition, that lie in no range taken by a successful run."""
    files = log.select(PARTITION, OFFSET).distinct().withColumn("bin", F.floor(F.col(OFFSET) / BIN))
    span = files.groupBy(PARTITION).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    taken = runs(sink_runs).where("state = 'success' and first_file <= last_file").join(span, PARTITION)
    first, last = F.greatest(F.floor(F.col("first_file") / BIN), "low"), F.least(F.floor(F.col("last_file") / BIN), "high")
    ranges = taken.withColumn("first", first).withColumn("last", last).where("first <= last").select(PARTITION, "first_file", "last_file", F.explode(F.sequence("first", "last")).alias("bin"))
    inside = (files[PARTITION] == ranges[PARTITION]) & (files["bin"] == ranges["bin"]) & files[OFFSET].between(ranges["first_file"], ranges["last_file"])
    return files.join(ranges, inside, "left_anti").select(PARTITION, OFFSET)


class IncrementalRun:
    """Batches planned ahead of their work, and a sink that takes each record once.

    ``plan`` writes the tables that say what a batch takes before anything is read for it. A plan without a commit is
    one whose run died: ``plan`` gives that one back as it was written, so it is replayed as planned even if the log has grown.
    ``execute`` writes the batch's records under its number, less those whose key and offset earlier batches put into the
    sink, and commits; doing it again overwrites the same files. ``records`` are those of committed batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Storage(spark)

    def _numbers(self, what: str) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.fs.names(f"{self.path}/{what}") if x.endswith(".json")]

    def plan(self, tables: Callable[[], dict[str, DataFrame]]) -> int:
        """The number of the batch to be run."""
        planned, done = self._numbers("plans"), self._numbers("commits")
        if open_ := set(planned) - set(done):
            return min(open_)
        number = len(planned)
        made = tables()
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{self.path}/planned/batch={number}/{name}")
        self.fs.create(f"{self.path}/plans/{number:09d}.json", {"batch": number, "tables": sorted(made)})
        return number

    def planned(self, number: int) -> dict[str, DataFrame]:
        names = self.fs.load(f"{self.path}/plans/{number:09d}.json")["tables"]
        return {x: self.spark.read.parquet(f"{self.path}/planned/batch={number}/{x}") for x in names}

    def execute(self, number: int, records: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        """Run a planned batch: ``records`` makes rows of RECORD and ``offset`` from its plan.

        Of the sink only those earlier batches are read whose offsets of a kind overlap with this one's.
        """
        if number in (done := self._numbers("commits")):
            return
        out = f"{self.path}/sink/batch={number}"
        found = stored(records(self.planned(number)).select(*RECORD, "offset").distinct(), f"{self.path}/staged/batch={number}")
        spans = {r["kind"] or "": [r["low"], r["high"]] for r in found.groupBy("kind").agg(F.min("offset").alias("low"), F.max("offset").alias("high")).collect()}  # three rows
        before = [x for x in done if self._overlap(self.fs.load(f"{self.path}/commits/{x:09d}.json").get("spans"), spans)]
        if before:
            both = found.withColumn("had", F.lit(False)).unionByName(self._sink(before).withColumn("had", F.lit(True)))
            found = both.groupBy(*RECORD, "offset").agg(F.max("had").alias("had")).where("not had").drop("had")
        found.write.mode("overwrite").parquet(out)
        self.fs.create(f"{self.path}/commits/{number:09d}.json", {"batch": number, "spans": spans, "compared_with": before})
        self.fs.delete(f"{self.path}/staged/batch={number}")

    @staticmethod
    def _overlap(old: dict | None, new: dict) -> bool:
        def meet(a: list, b: list) -> bool:
            return None in (*a, *b) or (a[0] <= b[1] and b[0] <= a[1])

        return old is None or any(k in old and meet(old[k], span) for k, span in new.items())

    def _sink(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/sink/batch={x}" for x in numbers]).select(*RECORD, "offset")

    def records(self) -> DataFrame:
        return self._sink(self._numbers("commits"))


def open_imports(import_jobs: DataFrame, numbered: bool = False) -> DataFrame:
    """(namespace, name, cursor): the newest job of each table (by created_at, then id) where it is neither completed nor expired. ``numbered``: with its id as ``job``."""
    newest = F.max_by(F.struct("id", "cursor", "completed_at", "expired_at"), F.struct("created_at", "id")).alias("job")
    jobs = import_jobs.groupBy(F.col("schema").alias("namespace"), F.col("table_name").alias("name")).agg(newest)
    return jobs.where("job.completed_at is null and job.expired_at is null").select(*TABLE, "job.cursor", *[F.col("job.id").alias("job")] * numbered)


def beyond(key: Column, cursor: Column, kind: Column) -> Column:
    """Whether a key comes after a cursor, both as text, in the order of the key's type. No cursor, one of no characters, or one that isn't of the type: all keys do."""

    def later(sql: str) -> Column:
        return key.try_cast(sql) > cursor.try_cast(sql)

    typed = (
        F.when(kind.isin("int2", "int4", "int8"), later("decimal(38,0)"))
        .when(kind == "numeric", later("decimal(38,18)"))
        .when(kind == "float8", later("double"))
        .when(kind.isin("date", "timestamptz"), later("timestamp"))
        .when(kind == "bool", later("boolean"))
        .otherwise(key > cursor)
    )
    return cursor.isNull() | (cursor == "") | F.coalesce(typed, cursor.isNotNull() & key.isNotNull())


def changed_jobs(import_jobs: DataFrame, sink_runs: DataFrame) -> DataFrame:
    """Import jobs updated after the start of the latest-started successful run of their subscription, or of one without such a run."""
    starts = runs(sink_runs).where("state = 'success'").groupBy(PARTITION).agg(F.max("started_at").alias("latest"))
    return import_jobs.join(starts, PARTITION, "left").where("latest is null or updated_at > latest")


def untaken_records(plan: dict[str, DataFrame], keyed: DataFrame, path: str) -> DataFrame:
    """What a batch takes, as RECORD and offset: changes none of whose deliveries was taken, rows beyond open imports' cursors, changed jobs.

    The offset of a row is its import job, so a newer job takes a row again (0 if the plan does not number the jobs).

    ``keyed``: modifications with key_columns and key_type. Only deliveries between the first and the last pending offset are read for news; the changes found
    there are looked up among taken deliveries, of which only those between their first and last lsn are read.
    """
    # A null partition or offset is a key of its own: it is in no taken range, so it is pending.
    whole = [F.coalesce(F.col(PARTITION).cast("string"), F.lit("")).alias("partition"), F.coalesce(OFFSET, F.lit(0)).alias("at")]
    nulls = F.concat(F.col(PARTITION).isNull().cast("string"), F.col(OFFSET).isNull().cast("string")).alias("nulls")
    pending = stored(plan["offsets"].select(*whole, nulls, F.lit(True).alias("pending")), f"{path}/offsets")
    order = F.coalesce("sequence", F.lit(0)).alias("sequence")
    missing = F.concat(*[F.col(c).isNull().cast("string") for c in TABLE]).alias("missing")
    names = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in TABLE]
    log = keyed.where("lsn is not null")
    delivery = [*whole, nulls, *names, missing, "lsn", order]
    change_id = [f"_{c}" for c in TABLE] + ["missing", "lsn", "sequence"]
    # The scan is told the span of pending offsets, and then that of the changes found there.
    low, high, some = pending.where("nulls = 'falsefalse'").agg(F.min("at"), F.max("at"), F.count("*")).first()
    without = pending.count() > some
    inside = F.col(OFFSET).between(low, high) if some else F.lit(False)
    near = log.where(inside | F.col(OFFSET).isNull() | F.col(PARTITION).isNull() if without else inside)
    on = ["partition", "at", "nulls"]
    news = stored(attach(near.select(*delivery), pending, f"{path}/pending", on, ["lsn", "sequence"], "inner").select(*change_id).distinct(), f"{path}/news")
    first, last = news.agg(F.min("lsn"), F.max("lsn")).first()
    there = log.where(F.col("lsn").between(first, last) if first is not None else F.lit(False))
    others = attach(there.select(*delivery), pending, f"{path}/pending-again", on, ["lsn", "sequence"]).where("pending is null").select(*change_id)
    taken = attach(others, news.withColumn("is_new", F.lit(True)), f"{path}/news-again", change_id, change_id, "inner").select(*change_id).distinct()
    changes = news.join(taken, change_id, "left_anti")
    table = [F.when(F.substring("missing", 1, 4) == "true", None).otherwise(F.col("_namespace")).alias("namespace"), F.when(F.col("missing").endswith("true"), None).otherwise(F.col("_name")).alias("name")]
    change = changes.select(F.lit("change").alias("kind"), *table, F.concat_ws("/", "lsn", "sequence").alias("record_key"), F.col("lsn").alias("offset"))
    imports = plan["imports"] if "job" in plan["imports"].columns else plan["imports"].withColumn("job", F.lit(0))
    imported = attach(keyed.where("lsn is null"), imports, f"{path}/imports", TABLE, ["timestamp", "after"], "inner")
    events = row_events(imported, payload=False, extra=["cursor", "key_type", "job"]).where("alive").where(beyond(F.col("row_key"), F.col("cursor"), F.col("key_type")))
    row = events.select(F.lit("row").alias("kind"), *TABLE, F.col("row_key").alias("record_key"), F.coalesce("job", F.lit(0)).cast("bigint").alias("offset")).distinct()
    job = plan["jobs"].select(F.lit("job").alias("kind"), F.col("schema").alias("namespace"), F.col("table_name").alias("name"), F.col("id").cast("string").alias("record_key"), F.unix_micros("updated_at").alias("offset"))
    return change.unionByName(row).unionByName(job)

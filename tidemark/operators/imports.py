"""Resumable imports: jobs, pages of a table by key, outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changelog import may_run

JOB = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("subscription_id", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("table_name", T.StringType()),
    T.StructField("cursor", T.StringType()), T.StructField("completed_at", T.TimestampType()), T.StructField("expired_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("error", T.StringType()), T.StructField("error_count", T.LongType()), T.StructField("last_error_at", T.TimestampType()),
    T.StructField("rows_processed_total", T.LongType()),
])


class NoPrimaryKey(ValueError):
    """A table without a key cannot be imported by key."""


class SeveralPrimaryKeys(ValueError):
    """Nor can one with a composite key."""


@dataclass(frozen=True)
class ImportOptions:
    """Rows of a page, and for how long one run goes on taking pages."""

    batch_limit: int = 5000
    timeout: timedelta = timedelta(minutes=1)


@dataclass(frozen=True)
class Outcome:
    """What a run of an import did."""

    rows: int
    cursor: str | None
    complete: bool


def key_column(columns: list[tuple[str, bool]]) -> str:
    """The single key column of a table's (name, is key) columns; NoPrimaryKey or SeveralPrimaryKeys otherwise."""
    keys = sorted(name for name, is_key in columns if is_key)
    if not keys:
        raise NoPrimaryKey("no primary key")
    if len(keys) > 1:
        raise SeveralPrimaryKeys("unsupported multiple primary keys: " + ", ".join(keys))
    return keys[0]


def key_lists(index_columns: DataFrame, group: list[str], name: str) -> DataFrame:
    """Key columns of each table, sorted and joined, and how many there are."""
    names = F.sort_array(F.collect_list(name))  # at most 1600 columns a table
    return index_columns.groupBy(*group).agg(F.array_join(names, ", ").alias("names"), F.count(name).alias("n"))


def page(source: DataFrame, key: str, cursor: Any, limit: int) -> DataFrame:
    """The next rows of a table after ``cursor`` in key order, at most ``limit``. The cursor is pushed into the scan."""
    rest = source if cursor is None else source.where(F.col(key) > F.lit(cursor))
    return rest.orderBy(key).limit(limit)


def typed_cursor(text: str | None, kind: T.DataType) -> Any:
    """A cursor kept as text as a value of the key's type. None or no characters: none."""
    if text is None or text == "":
        return None
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.FractionalType):
        return float(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(text)
    return text


def imported_rows(rows: DataFrame, namespace: str, name: str, read_at: datetime) -> DataFrame:
    """Rows of a page as modifications: no lsn, no image before, all with the time of the read."""
    after = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    none = F.lit(None)
    return rows.select(
        F.lit(read_at).alias("timestamp"), F.lit(namespace).alias("namespace"), F.lit(name).alias("name"),
        none.cast("bigint").alias("lsn"), none.cast("bigint").alias("sequence"), none.cast("string").alias("before"), after.alias("after"),
    )


def import_table(source: DataFrame, key: str, job: Row, sink: Callable[[DataFrame], None], options: ImportOptions = ImportOptions(), clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Outcome:
    """Take pages from the job's cursor until one is not full or time is up, each into ``sink`` before its cursor counts.

    Only the last key of a page and its count come to the driver. A full last page does not end an import: only one that
    is not full does. An empty page leaves the cursor as it was.
    """
    cursor, total, end = job["cursor"], 0, clock() + options.timeout
    while True:
        rows = page(source, key, typed_cursor(cursor, source.schema[key].dataType), options.batch_limit).persist()
        try:
            last, count = rows.agg(F.max(key).cast("string"), F.count("*")).first()
            if count:
                sink(imported_rows(rows, job["schema"], job["table_name"], clock()))
        finally:
            rows.unpersist()
        total, cursor = total + count, cursor if last is None else last
        if count < options.batch_limit:
            return Outcome(total, cursor, True)
        if clock() >= end:
            return Outcome(total, cursor, False)


def backfill(source: DataFrame, key: str, cursor: Any, namespace: str, name: str, read_at: datetime) -> DataFrame:
    """All rows after a cursor in one distributed read, for tables that need no pages."""
    return imported_rows(source if cursor is None else source.where(F.col(key) > F.lit(cursor)), namespace, name, read_at)


def jobs_frame(spark: SparkSession, jobs: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(jobs or [], JOB)


def missing_jobs(published: DataFrame, jobs: DataFrame, subscription_id: str) -> DataFrame:
    """(schema, table_name): published tables without an import that isn't expired."""
    live = jobs.where((F.col("subscription_id") == subscription_id) & F.col("expired_at").isNull())
    return published.select("schema", "table_name").distinct().join(live, ["schema", "table_name"], "left_anti")


def create_jobs(jobs: DataFrame, tables: DataFrame, subscription_id: str, now: datetime) -> DataFrame:
    """``jobs`` with a new one for each of ``tables``, numbered on from the largest id by schema and name."""
    start = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    listed = [tuple(r) for r in tables.select("schema", "table_name").distinct().orderBy("schema", "table_name").toLocalIterator()]
    new = [(start + i + 1, subscription_id, s, t, None, None, None, now, now, None, 0, None, 0) for i, (s, t) in enumerate(listed)]
    return jobs.unionByName(jobs_frame(jobs.sparkSession, new))


def runnable(jobs: DataFrame, subscription_id: str, now: datetime | Column) -> DataFrame:
    """Jobs of a subscription that are open and not waiting after a failure, healthy ones first, then by id."""
    open_ = (F.col("subscription_id") == subscription_id) & F.col("completed_at").isNull() & F.col("expired_at").isNull()
    return jobs.where(open_ & may_run(F.col("error_count"), F.col("last_error_at"), F.lit(now))).orderBy(F.col("error").isNull().desc(), "id")


def acquire(jobs: DataFrame, subscription_id: str, now: datetime | Column, taken: set[int] | None = None) -> Row | None:
    """The next job to work on, other than those ``taken`` by other workers."""
    free = runnable(jobs, subscription_id, now)
    return (free.where(~F.col("id").isin(sorted(taken))) if taken else free).first()


def _changed(jobs: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    return jobs.select(*[F.when(which, values[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in values else F.col(c) for c in jobs.columns])


def succeeded(jobs: DataFrame, job_id: int, outcome: Outcome, now: datetime) -> DataFrame:
    """Jobs after a run of one: its error cleared, its cursor and rows moved on, completed if the run came to the end."""
    values = {
        "cursor": F.lit(outcome.cursor), "error": F.lit(None), "error_count": F.lit(0), "updated_at": F.lit(now),
        "rows_processed_total": F.col("rows_processed_total") + outcome.rows, "completed_at": F.lit(now if outcome.complete else None),
    }
    return _changed(jobs, F.col("id") == job_id, values)


def failed(jobs: DataFrame, job_id: int, error: str, now: datetime) -> DataFrame:
    """Jobs after a failure of one: it waits the longer the more often it failed."""
    values = {"error": F.lit(error), "error_count": F.col("error_count") + 1, "last_error_at": F.lit(now), "updated_at": F.lit(now)}
    return _changed(jobs, F.col("id") == job_id, values)


def expired(jobs: DataFrame, subscription_id: str, schema: str, table_name: str, now: datetime) -> DataFrame:
    """Jobs after a table of a subscription was stopped: all of its jobs that aren't expired are."""
    which = (F.col("subscription_id") == subscription_id) & (F.col("schema") == schema) & (F.col("table_name") == table_name) & F.col("expired_at").isNull()
    return _changed(jobs, which, {"expired_at": F.lit(now), "updated_at": F.lit(now)})


class ImportWorker:
    """Takes jobs one by one until none can run. Jobs are control data, a row per import, kept as a table at ``path`` by version."""

    def __init__(self, spark: SparkSession, path: str, subscription_id: str, sources: Callable[[str, str], tuple[DataFrame, str]], sink: Callable[[DataFrame], None], options: ImportOptions = ImportOptions()):
        from ..functions.storage import Storage

        self.spark, self.path, self.subscription_id, self.sources, self.sink, self.options = spark, path.rstrip("/"), subscription_id, sources, sink, options
        self.fs = Storage(spark)

    def jobs(self) -> DataFrame:
        versions = [x for x in self.fs.names(f"{self.path}/commits") if x.endswith(".json")]
        return self.spark.read.schema(JOB).parquet(f"{self.path}/jobs-{versions[-1].removesuffix('.json')}") if versions else jobs_frame(self.spark)

    def save(self, jobs: DataFrame) -> None:
        number = f"{len([x for x in self.fs.names(f'{self.path}/commits') if x.endswith('.json')]):012d}"
        jobs.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/jobs-{number}")
        if not self.fs.create(f"{self.path}/commits/{number}.json", {"version": number}):
            raise RuntimeError("another worker changed the jobs")

    def work(self, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), most: int | None = None) -> int:
        """Run jobs; how many runs there were. A failed run is recorded and its job waits."""
        runs = 0
        while most is None or runs < most:
            job = acquire(self.jobs(), self.subscription_id, now())
            if job is None:
                break
            try:
                source, key = self.sources(job["schema"], job["table_name"])
                outcome = import_table(source, key, job, self.sink, self.options, now)
                self.save(succeeded(self.jobs(), job["id"], outcome, now()))
            except Exception as e:  # noqa: BLE001 - whatever went wrong, the job says so and waits
                self.save(failed(self.jobs(), job["id"], str(e).splitlines()[0][:500], now()))
            runs += 1
        return runs


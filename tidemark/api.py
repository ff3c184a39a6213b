"""What a service offers around a subscription, as Python methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.changelog import listed
from .operators import control, imports
from .sinks.raw_tables import BatchSink, RawTables
from .sources import replication
from .sources.pgoutput import decode
from .streaming.changelog_stream import changelog_stream
from .streaming.settings import rocksdb


@dataclass
class Options:
    """Intervals and sizes, by default as such a service has them."""

    flush: timedelta = timedelta(seconds=5)
    messages: int = replication.BATCH
    imports: imports.ImportOptions = field(default_factory=imports.ImportOptions)
    poll: timedelta = timedelta(seconds=15)


class Subscription:
    """The tables that are followed, their imports, and the stream into raw tables under ``path``.

    ``tables``: (schema, table_name) of all that could be followed. State is kept in files under ``path`` and read anew by
    every method, so several sessions may use it in turn; two that change it at once get an error, not a lost change.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, tables: DataFrame, options: Options | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.spark, self.path, self.name, self.tables, self.options, self.clock = spark, path.rstrip("/"), name, tables, options or Options(), clock
        self.raw = RawTables(spark, f"{self.path}/tables")
        self._publication = f"{self.path}/publication"

    def health(self) -> str:
        return "healthy" if self.spark.range(1).count() == 1 else "unhealthy"

    def _worker(self, sources: Callable[[str, str], tuple[DataFrame, str]] | None = None) -> imports.ImportWorker:
        return imports.ImportWorker(self.spark, f"{self.path}/jobs", self.name, sources or _no_source, self._land, self.options.imports)

    def published(self) -> DataFrame:
        versions = [x for x in self.raw.fs.names(self._publication) if x.endswith(".json")]
        rows = self.raw.fs.load(f"{self._publication}/{versions[-1]}")["tables"] if versions else []
        return self.spark.createDataFrame([tuple(r) for r in rows], "schema string, table_name string")

    def set_tables(self, tables: DataFrame) -> None:
        """Publish exactly these tables; none ends the publication of all. A list of tables is control data."""
        number = len([x for x in self.raw.fs.names(self._publication) if x.endswith(".json")])
        rows = sorted([r["schema"], r["table_name"]] for r in tables.select(*control.NAME).distinct().toLocalIterator())
        if not self.raw.fs.create(f"{self._publication}/{number:012d}.json", {"tables": rows}):
            raise RuntimeError("another session changed the publication")

    def reconcile(self, schemas: list[str] | None = None, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
        """Publish what is watched; (schema, table_name, action) of what changed."""
        changes = control.reconcile(control.watched(self.tables, schemas, includes, excludes), self.published()).collect()
        done = self.spark.createDataFrame(changes, "schema string, table_name string, action string")
        now = self.published()
        kept = control.difference(now, done.where("action = 'remove'")).unionByName(done.where("action = 'add'").select(*control.NAME))
        if changes:
            self.set_tables(kept)
        return done

    def reconcile_imports(self) -> DataFrame:
        """Create an import for each published table that has none; the tables concerned."""
        worker = self._worker()
        jobs = worker.jobs()
        missing = self.spark.createDataFrame(imports.missing_jobs(self.published(), jobs, self.name).collect(), "schema string, table_name string")
        if not missing.isEmpty():
            worker.save(imports.create_jobs(jobs, missing, self.name, self.clock()))
        return missing

    def add_table(self, schema: str, table_name: str) -> DataFrame:
        self.set_tables(control.add_table(self.published(), schema, table_name))
        return self.published()

    def stop_table(self, schema: str, table_name: str) -> DataFrame:
        """Stop following a table and expire its imports."""
        self.set_tables(control.remove_table(self.published(), schema, table_name))
        worker = self._worker()
        worker.save(imports.expired(worker.jobs(), self.name, schema, table_name, self.clock()))
        return self.published()

    def list_tables(self, schemas: str | None = None) -> DataFrame:
        """All tables with their statuses; ``schemas`` are comma-separated."""
        return control.table_list(self.tables, self.published(), self._worker().jobs(), self.name, listed(schemas) if schemas else None)

    def list_imports(self) -> DataFrame:
        return self._worker().jobs().where(F.col("subscription_id") == self.name)

    def run_imports(self, sources: Callable[[str, str], tuple[DataFrame, str]], most: int | None = None) -> int:
        """Work on open imports; ``sources`` gives the DataFrame and key column of a table."""
        return self._worker(sources).work(self.clock, most)

    def _land(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("namespace", "name").parquet(f"{self.path}/imported")

    def imported(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/imported")

    def start(self, recording: str, drain: bool = False, ack: Callable[[int], None] | None = None) -> StreamingQuery:
        """Follow a recorded replication stream into the raw tables, flushing at the interval, or all there is now if ``drain``."""
        replication.register(self.spark)
        source = self.spark.readStream.format("recorded_replication").option("path", recording).option("batch", self.options.messages).load()
        messages = decode(source, "data", ["slot", "position"]).select("slot", "position", "message")
        images = "map<string,string>"
        entries = changelog_stream(messages).select(
            "slot", "position", "kind", F.timestamp_micros("timestamp_us").alias("timestamp"), "namespace", "name", "lsn", "sequence", "message_type", "spec",
            F.from_json("before", images).alias("before"), F.from_json("after", images).alias("after"),
        )
        with rocksdb(self.spark):
            writer = entries.writeStream.foreachBatch(BatchSink(self.raw, ack)).option("checkpointLocation", f"{self.path}/checkpoint")
            interval = f"{self.options.flush.total_seconds()} seconds"
            query = (writer if drain else writer.trigger(processingTime=interval)).start()
            if drain:
                query.processAllAvailable()
                query.stop()
            return query


def _no_source(schema: str, table_name: str) -> tuple[DataFrame, str]:
    raise LookupError(f"no source for {schema}.{table_name}")

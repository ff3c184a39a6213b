"""A keyed table to which streams of inserts, updates and deletes are applied by bucketed copy-on-write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Versions
from .row_events import ORDER, ROW

STATE = "namespace string, name string, row_key string, ts bigint, is_change int, lsn bigint, sequence bigint, alive boolean, after string, bucket int"

#: Bytes that buckets hold on average at most.
BUCKET_BYTES = 1 << 30
#: Ids of batches that a manifest remembers, so that a replay of one of the last is known.
REMEMBERED = 1000


class BucketedTable(Versions):
    """Rows by hash of their key in buckets; each version is a manifest that names the files of every bucket.

    ``apply`` folds a batch of row events to the last one of each key (combined before the shuffle, so a hot key sends one
    row per map task), routes them to buckets, merges only the buckets they touch with a sort-merge join, writes
    replacement files for those, and commits a new manifest that keeps the other buckets' files. What is routed to a bucket without
    files is its first file as it stands. A manifest is created
    whole or not at all and never replaced: readers see one version, a writer that lost a race gets Conflict, and files
    of a run that died before its commit are never read.

    The order of events is (ts, is_change, lsn, sequence) within a key, not that of arrival. Ended rows stay as tombstones,
    so a change that arrives late cannot bring a row back. Applying the same batch, or any delivery, again changes
    nothing; ``batch_id`` makes a replay skip the work too. An empty batch commits no version. Buckets that hold over BUCKET_BYTES
    on average are split in as many as bring them below it (a power of two), so a touched bucket is never dear to rewrite.
    """

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).option("basePath", f"{self.path}/data").parquet(*folders).drop("batch").withColumn("bucket", F.col("bucket").cast("int"))

    def rows(self, version: int | None = None, ended: bool = False) -> DataFrame:
        """The table at a version: existing rows, with ``ended`` tombstones too."""
        found = self._read(sorted(self.manifest(version)["files"].values())).drop("bucket")
        return found if ended else found.where("alive")

    def apply(self, events: DataFrame, batch_id: str | None = None) -> int:
        """Apply row events (columns as of row_events); the version that holds them."""
        if (full := self.size() // (self.manifest()["buckets"] * BUCKET_BYTES)) > 0:
            self.split(2 ** full.bit_length())
        old = self.manifest()
        if batch_id is not None and batch_id in old["batches"]:
            return old["version"]
        count, tag = old["buckets"], uuid.uuid4().hex
        routed_at, merged_at = f"{self.path}/data/batch={tag}", f"{self.path}/data/batch={tag}-merged"
        last = F.max(F.struct(*ORDER, "alive", "after")).alias("last")
        self._write(events.groupBy(*ROW).agg(last).select(*ROW, "last.*").withColumn("bucket", self._bucket(count)), routed_at, count)
        touched = [int(x.partition("=")[2]) for x in self.fs.names(routed_at) if x.startswith("bucket=")]
        held = [b for b in touched if str(b) in old["files"]]
        if held:
            self._write(self._merge([old["files"][str(b)] for b in held], [f"{routed_at}/bucket={b}" for b in held]), merged_at, count)
        files = {**old["files"], **{str(b): f"{merged_at if b in held else routed_at}/bucket={b}" for b in touched}}
        if not touched and batch_id is None:
            return old["version"]
        version = self.commit(old, files=files, batches=[*old["batches"], *([batch_id] if batch_id else [])][-REMEMBERED:])
        for b in held:
            self.fs.delete(f"{routed_at}/bucket={b}")
        return version

    def split(self, factor: int) -> int:
        """The same rows in ``factor`` times as many buckets, as a new version."""
        old, at = self.manifest(), f"{self.path}/data/batch={uuid.uuid4().hex}"
        count = old["buckets"] * factor
        rows = self._read(sorted(old["files"].values())).withColumn("bucket", self._bucket(count))
        rows.repartition(count, *ROW).write.partitionBy("bucket").parquet(at)
        return self.commit(old, buckets=count, files={x.partition("=")[2]: f"{at}/{x}" for x in self.fs.names(at) if x.startswith("bucket=")})

    @staticmethod
    def _bucket(count: int):
        """The partition to which Spark's own hash partitioning over the key sends a row, so aggregation and join leave buckets whole."""
        return F.pmod(F.hash(*ROW), F.lit(count))

    def _write(self, df: DataFrame, path: str, count: int) -> None:
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != count:
            df = df.repartition(count, *ROW)
        df.write.partitionBy("bucket").parquet(path)

    def _merge(self, base: list[str], routed: list[str]) -> DataFrame:
        new = self._read(routed)
        kept = [*ORDER, "alive", "after"]
        was = self._read(base).select(*ROW, "bucket", F.struct(*kept).alias("was"))
        now = new.select(F.col("namespace").alias("n1"), F.col("name").alias("n2"), F.col("row_key").alias("n3"), F.col("bucket").alias("b"), F.struct(*kept).alias("now"))
        same = F.col("namespace").eqNullSafe(F.col("n1")) & F.col("name").eqNullSafe(F.col("n2")) & F.col("row_key").eqNullSafe(F.col("n3"))
        joined = was.join(now.hint("merge"), same, "full_outer")
        last = F.greatest("was", "now")
        present = F.col("row_key").isNotNull()
        return joined.select(
            F.when(present, F.col("namespace")).otherwise(F.col("n1")).alias("namespace"),
            F.when(present, F.col("name")).otherwise(F.col("n2")).alias("name"),
            F.coalesce("row_key", "n3").alias("row_key"),
            F.coalesce("bucket", "b").alias("bucket"),
            last.alias("last"),
        ).select(*ROW, "last.*", "bucket")

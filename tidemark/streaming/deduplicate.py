"""Exactly one copy of every message of an at-least-once stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import Storage
from .settings import rocksdb


class Deduplicator:
    """A keyed streaming state store of seen identifiers, with a lookup behind it for what the store has forgotten.

    ``run`` takes what a stream of deliveries has now, ``replay`` a stored table of them as the stream that it was, in batches by event time. Deliveries of one identifier (``keys``, nulls equal each other) within an Arrow batch are
    collapsed before the shuffle, so the copies of one message may be any share of all rows. Their keys pass Spark's state
    store (RocksDB), which lets the first of each identifier through and forgets it once the watermark, the largest
    ``event_time`` less ``delay``, has passed it. Two kinds of delivery escape the store: a repeat of a forgotten
    identifier, and a delivery whose own event time lies behind the watermark, which Spark drops. Both are looked up among
    the copies kept by earlier batches, which are stored by bucket of their keys: only the buckets of identifiers in question are read, and of these only
    the part from the least ``order`` in question on. An identifier beyond the greatest ``order`` that earlier batches reached cannot be
    among them (``order`` is a number) and is not looked up.

    An identifier is kept if the store let it through, or came too late for the store, and the lookup does not know it. It is a repeat if the batch has a
    delivery of it that was not kept. Each micro-batch is written under its own number and becomes visible by a commit file that also has the event time
    reached; a batch repeated after a failure overwrites its files and yields the same rows. The state is checkpointed by the
    same query, which goes on from the last batch committed.

    kept(): one row per identifier: ``keys``, and of the deliveries in its first batch the least ``event_time``, the least ``copy`` and the
    columns of ``payload`` as that copy has them. repeats(): the identifiers delivered more than once.
    A null event time counts as 1970; it is late, and so is looked up. Columns other than those named are ignored, and
    those named must not be called as the operator's own (RESERVED). Of no deliveries nothing is kept.
    """

    RESERVED = {"copies", "slice", "let_through", "n", "known", "asked", "eligible", "is_new", "is_repeat", "latest", "bucket", "batch", "_at"}

    def __init__(self, spark: SparkSession, path: str, keys: list[str], event_time: str, copy: str, order: str, delay: str = "7 days", payload: list[str] | None = None):
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Storage(spark)
        self.keys, self.event_time, self.copy, self.order, self.delay, self.payload = keys, event_time, copy, order, delay, payload or []
        self.fields = [*keys, event_time, copy, *self.payload]
        if taken := self.RESERVED & set(self.fields):
            raise ValueError(f"columns named {sorted(taken)} must be renamed")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not self.fs.create(f"{self.path}/layout.json", {"buckets": self.buckets}):
            self.buckets = self.fs.load(f"{self.path}/layout.json")["buckets"]

    def _collapsed(self, deliveries: DataFrame, by: list[str]) -> DataFrame:
        copy = self.copy

        def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return collapsed(batches, by, copy)

        return deliveries.mapInArrow(collapse, T.StructType([*deliveries.schema.fields, T.StructField("copies", T.LongType())]))

    def _narrow(self, deliveries: DataFrame, more: list[Column] | None = None) -> DataFrame:
        self._schema = T.StructType([deliveries.schema[c] for c in self.fields])
        return deliveries.select(*self.fields, *(more or [])).withColumn(self.event_time, F.coalesce(self.event_time, F.timestamp_micros(F.lit(0))))

    def run(self, source: DataFrame) -> None:
        """Take all that is available now; a later run goes on after it."""
        self._take(self._collapsed(self._narrow(source), self.keys))

    def replay(self, deliveries: DataFrame, batches: int) -> None:
        """Take stored deliveries in batches of equal spans of event time, oldest first.

        The table is read once: it is collapsed and laid out by span, each span then arrives in turn. After a failure, spans that had arrived are taken from the
        checkpoint on; none is taken twice.
        """
        at, arrived = f"{self.path}/landing", f"{self.path}/arrived"
        narrow = self._narrow(deliveries)
        if not self.fs.exists(f"{self.path}/landed.json"):
            us = F.unix_micros(self.event_time)
            low, high = narrow.agg(F.min(us), F.max(us)).first()
            part = F.lit(0) if low is None else F.expr(f"cast(((unix_micros(`{self.event_time}`) - {low}L) * {batches}L) div {high - low + 1}L as int)")
            laid = self._collapsed(narrow.withColumn("slice", part), [*self.keys, "slice"])
            laid.write.mode("overwrite").partitionBy("slice").parquet(at)
            self.fs.create(f"{self.path}/landed.json", {"batches": batches})
        schema = T.StructType([*narrow.schema.fields, T.StructField("copies", T.LongType())])
        self.fs.make_folder(arrived)
        for name in [x for x in (f"slice={i}" for i in range(batches)) if self.fs.exists(f"{at}/{x}") or self.fs.exists(f"{arrived}/{x}")]:
            self.fs.move(f"{at}/{name}", f"{arrived}/{name}")
            self._take(self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(arrived))
        self.fs.delete(at)

    def _take(self, seen: DataFrame) -> None:
        seen = seen.withWatermark(self.event_time, self.delay)
        first = seen.select(*self.keys, self.event_time).dropDuplicatesWithinWatermark(self.keys).withColumn("let_through", F.lit(1))
        tagged = seen.withColumn("let_through", F.lit(0)).unionByName(first, allowMissingColumns=True)
        with rocksdb(self.spark):
            query = tagged.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            self.forgotten = sum(x.numRowsRemoved for p in query.recentProgress for x in p.stateOperators)

    def _commits(self, before: int | None = None) -> list[int]:
        """Numbers of the committed batches."""
        found = [int(x.removesuffix(".json")) for x in self.fs.names(f"{self.path}/commits") if x.endswith(".json")]
        return [x for x in found if before is None or x < before]

    def _batch(self, tagged: DataFrame, number: int) -> None:
        spark = tagged.sparkSession
        at, out = f"{self.path}/staged/batch={number}", f"{self.path}/out/batch={number}"
        earlier = self._commits(number)
        known = [self.fs.load(f"{self.path}/commits/{x:09d}.json") for x in earlier]
        reached = max([x["event_us"] for x in known if x["event_us"] is not None], default=None)
        beyond = max([x["order"] for x in known if x["order"] is not None], default=None)
        passed = F.lit(0).cast("timestamp") if reached is None else F.timestamp_micros(F.lit(reached)) - F.expr(f"INTERVAL {self.delay}") + F.expr("INTERVAL 1 SECOND")
        raw = F.col("let_through") == 0
        payload = F.min_by(F.when(raw, F.struct(*self.payload)), F.when(raw, F.col(self.copy))).alias("payload")
        ids = tagged.groupBy(*self.keys).agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
            F.max("let_through").alias("let_through"),
            F.min(self.event_time).alias(self.event_time),
            F.max(self.event_time).alias("latest"),
            F.min(self.copy).alias(self.copy),
            *([payload] if self.payload else []),
        )
        ids = ids.select("*", F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket"), ((F.col("let_through") == 1) | (F.col(self.event_time) <= passed)).alias("eligible"))
        if earlier:
            order = F.col(self.order)
            ids = ids.withColumn("asked", F.col("eligible") & (order.isNull() | (order <= F.lit(beyond))) if beyond is not None else F.col("eligible") & order.isNull())
            ids.write.mode("overwrite").parquet(at)
            ids = spark.read.schema(ids.schema).parquet(at)
            if ids.isEmpty():  # a batch in which the store only forgets
                self._commit(number, None, None, 0)
                return
            ids = self._look_up(ids, earlier)
        else:
            ids = ids.withColumn("known", F.lit(False))
        new = F.col("eligible") & ~F.col("known")
        shown = ids.select(
            *self.keys, self.event_time, self.copy, *[F.col(f"payload.{c}").alias(c) for c in self.payload], "latest", "bucket",
            F.col("known"), new.alias("is_new"), (F.col("n") > new.cast("int")).alias("is_repeat"),
        )
        shown.sortWithinPartitions("bucket", self.order).write.mode("overwrite").partitionBy("bucket").parquet(out)
        fresh = self._out(spark, [number])
        event, order, found = fresh.agg(F.max(F.unix_micros("latest")), F.max(self.order), F.count_if("known")).first()
        self._commit(number, event, order, found)

    def _commit(self, number: int, event: int | None, order: int | None, found: int) -> None:
        if not self.fs.exists(f"{self.path}/commits/{number:09d}.json"):
            self.fs.create(f"{self.path}/commits/{number:09d}.json", {"batch": number, "event_us": event, "order": order, "found_by_lookup": found})
        self.fs.delete(f"{self.path}/staged/batch={number}")

    def _look_up(self, ids: DataFrame, earlier: list[int]) -> DataFrame:
        """ids with ``known``: whether an earlier batch kept a copy."""
        asked = ids.where("asked")
        low, some, without = asked.agg(F.min(self.order), F.collect_set("bucket"), F.count_if(F.col(self.order).isNull())).first()  # a number for each bucket
        order = F.col(self.order)
        kept = self._kept(self.spark, earlier).where(F.col("bucket").isin(some))
        kept = kept.where(order >= low if low is not None and not without else order.isNull() if low is None else (order >= low) | order.isNull())
        kept = kept.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)], F.lit(True).alias("known"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.keys)])
        found = asked.join(kept, same, "left").drop(*[f"_{i}" for i in range(len(self.keys))]).withColumn("known", F.coalesce("known", F.lit(False)))
        return found.unionByName(ids.where("not asked").withColumn("known", F.lit(False)))

    def _kept(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        return self._out(spark, numbers).where("is_new")

    def _out(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        flags = [T.StructField("latest", T.TimestampType()), *[T.StructField(c, T.BooleanType()) for c in ("known", "is_new", "is_repeat")], T.StructField("bucket", T.IntegerType())]
        schema = T.StructType([*self._schema.fields, *flags])
        folders = [x for x in (f"{self.path}/out/batch={n}" for n in numbers) if self.fs.exists(x)]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/out").parquet(*folders)

    def kept(self) -> DataFrame:
        return self._kept(self.spark, self._commits()).select(*self.fields)

    def repeats(self) -> DataFrame:
        return self._out(self.spark, self._commits()).where("is_repeat").select(*self.keys).distinct()


def collapsed(batches: Iterator[pa.RecordBatch], keys: list[str], copy: str) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch that have the same keys, the one with the least ``copy``, with the number of them in ``copies``."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).append_column("_at", pa.array(range(batch.num_rows), pa.int64())).sort_by(copy)
        best = rows.group_by(keys, use_threads=False).aggregate([("_at", "first"), ("_at", "count")])
        taken = pa.Table.from_batches([batch]).take(best["_at_first"])
        yield from taken.append_column("copies", best["_at_count"].cast(pa.int64())).combine_chunks().to_batches()

"""Every version of every source row with the period in which it was valid, kept as checkpoints and patches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.images import entries, entries_json, image
from ..functions.storage import Versions, attach
from .row_events import ORDER, ROW
from .segments import carried, segmented

PAIRS = "array<struct<key: string, value: string>>"
STEP = f"struct<pos: int, ts: bigint, is_change: int, lsn: bigint, sequence: bigint, kind: string, changed: boolean, until: bigint, set: {PAIRS}, unset: array<string>>"
STORE = f"namespace string, name string, row_key string, since bigint, upto bigint, steps array<{STEP}>, bucket int"
START = -(1 << 63)


class HistoryStore(Versions):
    """Checkpoint-delta storage of row histories, in buckets by hash of the row.

    A row's history is a list of chains of at most ``every`` steps, each stored as one record: a checkpoint (the full version at its head) and
    patches of the attributes set and unset since. Every state of a row that is last at its time is a step, also one that changes nothing, so that
    what arrives late finds its place. ``versions`` and ``as_of`` fold the patches of each chain forward from its checkpoint, where it lies,
    without a shuffle; no task holds the history of a row, however long. A step that brings a version knows when that ends.

    ``apply`` takes a batch of row events: it reads the buckets that the batch touches, unfolds the chains of the rows concerned only, puts both in order,
    and writes new files for those buckets; a manifest, created whole and never replaced, names the files of every bucket (a writer that lost a race gets
    Conflict). Rows of long histories are taken in stretches of their order (``segments``), so a hot row is no one task.

    Of several states of one row at one time only the last (is_change, lsn, sequence) counts; equal states in succession are
    one version, so copies of a delivery change nothing. Null attributes are left out. An image without attributes is a
    version without attributes. Without events there are no versions. Batches may come in any order.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 32, buckets: int | None = None):
        super().__init__(spark, path, buckets)
        self.every = every

    def apply(self, events: DataFrame) -> int:
        """Add row events (columns as of row_events); the version that holds them."""
        old, tag = self.manifest(), uuid.uuid4().hex
        bucket = F.pmod(F.hash(*ROW), F.lit(old["buckets"]))
        state = F.when(F.col("alive"), entries_json(entries(image(F.col("after")))))
        rows = self._stage(events.select(*ROW, *ORDER, "alive", state.alias("state")), f"staged-{tag}")
        rest = None
        if old["files"]:
            touched = {str(r[0]) for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most as many as there are buckets
            if held := [old["files"][b] for b in sorted(touched) if b in old["files"]]:
                keys = rows.select(*ROW).distinct()
                chains = self._read(held)
                rest = chains.join(keys, ROW, "left_anti")
                rows = self._stage(rows.unionByName(self._unfolded(chains.join(keys, ROW, "left_semi"))), f"joined-{tag}")
        made = self._chains(rows, tag)
        if rest is not None:
            made = made.unionByName(rest.select(*made.columns))
        made.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/data/batch={tag}")
        new = {x.partition("=")[2]: f"{self.path}/data/batch={tag}/{x}" for x in self.fs.names(f"{self.path}/data/batch={tag}") if x.startswith("bucket=")}
        for x in (f"staged-{tag}", f"joined-{tag}", f"large-{tag}"):
            self.fs.delete(f"{self.path}/{x}")
        return self.commit(old, files={**old["files"], **new}) if new else old["version"]

    def _stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written once, as they are read several times."""
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _chains(self, rows: DataFrame, tag: str) -> DataFrame:
        cut, large = segmented(rows, ROW, "ts")
        if not large:
            return self._folded(self._steps(cut.drop("segment").withColumn("is_carried", F.lit(False)), ROW), ROW)
        small = self._folded(self._steps(cut.where("segment < 0").drop("segment").withColumn("is_carried", F.lit(False)), ROW), ROW)
        group = [*ROW, "segment"]
        own = cut.where("segment >= 0").withColumn("is_carried", F.lit(False))
        before = carried(own, ROW, ORDER, ["alive", "state"])
        first = [F.lit(START).alias("ts"), F.lit(0).alias("is_change"), F.lit(0).cast("bigint").alias("lsn"), F.lit(0).cast("bigint").alias("sequence")]
        steps = self._stage(self._steps(own.unionByName(before.select("*", *first, F.lit(True).alias("is_carried"))), group), f"large-{tag}")
        # What follows the last step and the last version of a stretch is in a later one.
        heads = steps.groupBy(*group).agg(F.min("ts").alias("head"), F.min(F.when(F.col("changed"), F.col("ts"))).alias("head_changed"))
        later = Window.partitionBy(*ROW).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_SEGMENTS rows a group
        ahead = heads.select(*group, F.last("head").over(later).alias("next_head"), F.last("head_changed", ignorenulls=True).over(later).alias("next_changed"))
        timed = attach(steps, ahead, f"{self.path}/heads-{tag}", group, ["pos"])
        timed = timed.withColumn("ts_after", F.coalesce("ts_after", "next_head")).withColumn("until", F.coalesce("until", "next_changed")).drop("next_head", "next_changed")
        return small.unionByName(self._folded(timed, group))

    def _steps(self, rows: DataFrame, group: list[str]) -> DataFrame:
        """The last state at each time, in order, with what kind of step it is from the state before and until when a version lasts."""
        in_order, backwards = Window.partitionBy(*group).orderBy(*ORDER), Window.partitionBy(*group).orderBy(*[F.desc(c) for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
        last = rows.withColumn("ts_after", F.lead("ts").over(in_order)).where("ts_after is null or ts_after <> ts")
        compared = last.select("*", F.lag("alive").over(in_order).alias("was_alive"), F.lag("state").over(in_order).alias("was"))
        lived = F.coalesce("was_alive", F.lit(False))
        changed = F.when(F.col("alive"), ~lived | ~F.col("state").eqNullSafe(F.col("was"))).otherwise(lived)
        own = compared.where("not is_carried").select("*", lived.alias("lived"), changed.alias("changed"), F.row_number().over(in_order).alias("pos")).drop("is_carried", "was_alive")
        kind = F.when(~F.col("alive"), "end").when(~F.col("lived") | ((F.col("pos") - 1) % self.every == 0), "full").when(F.col("changed"), "patch").otherwise("same")
        until = F.last(F.when(F.col("changed"), F.col("ts")), ignorenulls=True).over(backwards)
        return own.select(*group, *ORDER, "pos", "ts_after", kind.alias("kind"), "changed", until.alias("until"), "state", "was")

    def _folded(self, steps: DataFrame, group: list[str]) -> DataFrame:
        """Steps as chains: (ROW, since, upto, steps), upto null where nothing follows."""
        now = F.when(F.col("kind").isin("full", "patch"), entries(image(F.col("state"))))
        was = F.when(F.col("kind") == "patch", entries(image(F.col("was"))))
        both = steps.withColumn("now", now).withColumn("was", was)
        patch = F.col("kind") == "patch"
        unset = F.array_except(F.transform("was", lambda e: e["key"]), F.transform("now", lambda e: e["key"]))
        step = F.struct("pos", *ORDER, "kind", "changed", F.coalesce("until", F.lit(0)).alias("until"), F.when(patch, F.array_except("now", "was")).otherwise(F.col("now")).alias("set"), F.when(patch, unset).alias("unset"))
        chain = F.floor((F.col("pos") - 1) / self.every).alias("chain")
        chains = both.groupBy(*group, chain).agg(F.min("ts").alias("since"), F.max_by("ts_after", "pos").alias("upto"), F.sort_array(F.collect_list(step)).alias("steps"))  # at most ``every`` steps
        return chains.select(*ROW, "since", "upto", F.col("steps").cast(f"array<{STEP}>").alias("steps"))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).option("basePath", f"{self.path}/data").parquet(*folders).drop("batch")

    def chains(self) -> DataFrame:
        """What is stored: (namespace, name, row_key, since, upto, steps, bucket)."""
        return self._read(sorted(self.manifest()["files"].values()))

    @staticmethod
    def _fold(steps: Column, shape: str, made: Callable[[Column, Column], Column], kept: Callable[[Column], Column]) -> Column:
        """Patches folded forward from the chain's head: an array of what ``made`` makes of a step and the attributes then, of the steps ``kept``."""
        start = F.struct(F.array().cast(PAIRS).alias("state"), F.array().cast(f"array<{shape}>").alias("out"))

        def fold(acc: Column, step: Column) -> Column:
            keys = F.transform(step["set"], lambda e: e["key"])
            rest = F.filter(acc["state"], lambda e: ~F.array_contains(keys, e["key"]) & ~F.array_contains(step["unset"], e["key"]))
            state = F.when(step["kind"] == "full", step["set"]).when(step["kind"] == "patch", F.array_sort(F.concat(rest, step["set"]))).when(step["kind"] == "same", acc["state"]).otherwise(F.array().cast(PAIRS))
            return F.struct(state.alias("state"), F.when(kept(step), F.concat(acc["out"], F.array(made(step, state)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(steps, start, fold, lambda acc: acc["out"])

    def _unfolded(self, chains: DataFrame) -> DataFrame:
        """The events that chains were made of: (ROW, ORDER, alive, state)."""
        shape = f"struct<ts: bigint, is_change: int, lsn: bigint, sequence: bigint, alive: boolean, pairs: {PAIRS}>"
        out = self._fold(F.col("steps"), shape, lambda step, state: F.struct(*[step[c].alias(c) for c in ORDER], (step["kind"] != "end").alias("alive"), state.alias("pairs")), lambda step: F.lit(True))
        return chains.select(*ROW, F.explode(out).alias("e")).select(*ROW, *[f"e.{c}" for c in ORDER], "e.alive", F.when(F.col("e.alive"), entries_json(F.col("e.pairs"))).alias("state"))

    def versions(self) -> DataFrame:
        """(namespace, name, row_key, valid_from, valid_to, attributes); times in microseconds, valid_to 0 while valid."""
        shape = f"struct<valid_from: bigint, valid_to: bigint, attributes: {PAIRS}>"
        out = self._fold(F.col("steps"), shape, lambda step, state: F.struct(step["ts"].alias("valid_from"), step["until"].alias("valid_to"), state.alias("attributes")), lambda step: step["changed"] & (step["kind"] != "end"))
        return self.chains().select(*ROW, F.explode(out).alias("v")).select(*ROW, "v.*")

    def as_of(self, time: int) -> DataFrame:
        """(namespace, name, row_key, attributes) of the rows that existed at a time in microseconds: only the chains that hold it are read, and folded up to it."""
        there = self.chains().where((F.col("since") <= time) & (F.col("upto").isNull() | (F.col("upto") > time)))
        steps = F.filter("steps", lambda step: step["ts"] <= time)
        out = F.try_element_at(self._fold(steps, f"struct<alive: boolean, attributes: {PAIRS}>", lambda step, state: F.struct((step["kind"] != "end").alias("alive"), state.alias("attributes")), lambda step: F.lit(True)), F.lit(-1))
        return there.select(*ROW, out.alias("v")).where("v.alive").select(*ROW, "v.attributes")

"""Mixtures of sources by target shares, drawn in blocks by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import attach, stored

#: The split of a byte-level vocabulary's text into pieces (fixed values: the pattern published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a shard holds, as long as there are from 16 to 4096 shards.
SHARD_TOKENS = 1 << 28
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Passes over a source up to which its blocks stay as they are; with more of them fewer, larger blocks are drawn, so a plan does not grow with repeats.
FINE_PASSES, LEAST_BLOCKS = 8, 16


def source_name(source: Column) -> Column:
    """Spellings of a source differ in case and outer blanks."""
    return F.lower(F.trim(source))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document with a source: tokens of its whole text, 0 for a null one. The vocabulary's file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(tokens, pa.int64())], ["doc_id", "source", "tokens"])

    named = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where("source is not null")
    return named.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


def draw_plan(blocks: pd.DataFrame, targets: pd.DataFrame, shards: int, seed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Which blocks go where, from the blocks' (source, block, tokens), the source null where it has no target, and the targets' (source, target_share, max_repeats).

    Each source's quota is its share of all tokens, at most max_repeats times what it has. Its blocks are taken in permuted
    order, pass after pass, until the quota is reached; of the last, only ``limit`` tokens. The tree then splits the counts of blocks
    of all sources over the shards: at each node one half gets a multivariate-hypergeometric draw of the counts, so
    every block is drawn once and each shard's counts are those of a random cut. Returns (source, block, pass, shard,
    limit), limit null for a whole block, and (source, available, quota, blocks): of a source drawn in more than FINE_PASSES passes ``block`` is
    the number of a block modulo ``blocks``.
    """
    rng = np.random.default_rng(seed)
    total = int(blocks["tokens"].sum())
    draws, quotas = [], []
    for t in targets.sort_values("source").itertuples():
        own = blocks[(blocks["source"] == t.source) & (blocks["tokens"] > 0)].sort_values("block")
        have = int(own["tokens"].sum())
        repeats = int(t.max_repeats) if not pd.isna(t.max_repeats) else 0
        quota = min(int(round((0.0 if pd.isna(t.target_share) else t.target_share) * total)), have * max(0, repeats))
        passes, most = -(-quota // have) if have else 0, int(own["block"].max()) + 1 if have else 1
        merged = most if passes <= FINE_PASSES else max(min(LEAST_BLOCKS, most), most * FINE_PASSES // passes)
        own = own.assign(block=own["block"] % merged).groupby("block", as_index=False)["tokens"].sum()
        quotas.append((t.source, have, quota, merged))
        left, number = quota, 0
        while left > 0:
            order = rng.permutation(len(own))
            size = own["tokens"].to_numpy()[order]
            whole = int(np.searchsorted(np.cumsum(size), left, side="right"))
            block = own["block"].to_numpy()[order]
            draws += [(t.source, int(b), number, np.nan) for b in block[:whole]]
            left -= int(size[:whole].sum())
            if whole < len(own) and left > 0:
                draws.append((t.source, int(block[whole]), number, float(left)))
                left = 0
            number += 1
    plan = pd.DataFrame(draws, columns=["source", "block", "pass", "limit"]).astype({"block": "int64", "pass": "int64", "limit": "float64"})
    counts = plan.groupby("source").size().sort_index()
    plan["shard"] = 0
    if len(plan):
        cuts = _split(counts.to_numpy(), shards, rng)
        for j, source in enumerate(counts.index):
            rows = plan.index[plan["source"] == source].to_numpy()
            plan.loc[rng.permutation(rows), "shard"] = np.repeat(np.arange(shards), cuts[:, j])
    return plan[["source", "block", "pass", "shard", "limit"]], pd.DataFrame(quotas, columns=["source", "available", "quota", "blocks"])


def _split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of each shard (rows) and source: the counts of a node are cut in two at random until each shard has its own."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    share = total * left // shards
    taken = rng.multivariate_hypergeometric(counts, share, method="marginals") if total else counts
    return np.concatenate([_split(taken, left, rng), _split(counts - taken, shards - left, rng)])


class Mixture:
    """A mixture of documents by tokens.

    Tokens are counted once and stored. Documents fall into ``blocks`` blocks a source by a hash of their id, whose token sums
    are all that reaches the driver (blocks times sources, at every size). Only the block in which a quota ends is looked
    into by document: its documents are taken in hashed order while they fit, so a source ends within one document of its
    quota. ``drawn`` gives the copies with their shard and place in it.

    A document in the input twice counts twice. Sources without documents, without a share or with no repeats
    contribute nothing; sources without a target count in the total but are not drawn.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, path: str, vocabulary: str = VOCABULARY, blocks: int = 2048, shards: int | None = None, seed: int = 7):
        self.spark: SparkSession = documents.sparkSession
        self.path, self.seed = path.rstrip("/"), seed
        block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).alias("block")
        self.sizes = stored(token_counts(documents, vocabulary).select("*", block), f"{self.path}/sizes")
        targets = mix_targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        self.targets = targets.toPandas().astype({"max_repeats": "Int64"})
        known = self.sizes.select("*", F.when(F.col("source").isin(self.targets["source"].tolist()), F.col("source")).alias("known"))
        sums = known.groupBy(F.col("known").alias("source"), "block").agg(F.sum("tokens").alias("tokens")).toPandas()
        self.total = int(sums["tokens"].sum())
        self.shards = shards or max(16, min(4096, self.total // SHARD_TOKENS))
        self.plan, self.quotas = draw_plan(sums, self.targets, self.shards, seed)

    def drawn(self) -> DataFrame:
        """(shard, place, doc_id, source, pass, tokens): every copy, shuffled within its shard."""
        plan = self.spark.createDataFrame(self.plan.astype(object).where(self.plan.notna(), None), "source string, block bigint, pass bigint, shard int, limit double")
        draws = plan.groupBy("source", F.col("block").alias("part")).agg(F.collect_list(F.struct("pass", "shard", "limit")).alias("draws"))  # a few passes
        merged = F.coalesce(*[F.when(F.col("source") == r.source, F.lit(r.blocks)) for r in self.quotas.itertuples()], F.lit(1))  # a source a target
        sized = self.sizes.where("tokens > 0").withColumn("part", F.pmod("block", merged))
        placed = attach(sized, draws, f"{self.path}/plan-{uuid.uuid4().hex}", ["source", "part"], ["doc_id"], "inner").withColumn("draw", F.explode("draws"))
        docs = placed.select("doc_id", "source", "tokens", F.col("part").alias("block"), "draw.*")
        order = F.xxhash64("doc_id", "pass", F.lit(self.seed + 1))
        whole = docs.where("limit is null")
        by_hash = Window.partitionBy("source", "block", "pass").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        part = docs.where("limit is not null").withColumn("upto", F.sum("tokens").over(by_hash)).where("upto <= limit").drop("upto")
        by_shard = Window.partitionBy("shard").orderBy(order, "doc_id", "source")
        return whole.unionByName(part).select("shard", F.row_number().over(by_shard).alias("place"), "doc_id", "source", "pass", "tokens")

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, available, quota, tokens, documents, most_repeats, share_of_total, share_of_mix) of each target."""
        used = self.drawn().groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"))
        sums = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_repeats"))
        targets = self.targets.merge(self.quotas, on="source")[["source", "target_share", "max_repeats", "available", "quota"]]
        asked = self.spark.createDataFrame(targets.astype(object).where(targets.notna(), None), "source string, target_share double, max_repeats bigint, available bigint, quota bigint")
        joined = asked.join(F.broadcast(sums), "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
        mix = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
        return joined.select("*", (F.col("tokens") / F.lit(float(max(1, self.total)))).alias("share_of_total"), F.try_divide(F.col("tokens"), mix).alias("share_of_mix"))

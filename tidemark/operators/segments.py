"""Groups too large for one task, cut into stretches of their order."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is large if it has more than this share of all rows, or more than this many rows.
LARGE_SHARE, LARGE_ROWS = 1 / 512, 4_000_000
#: Rows of large groups are cut into stretches of about LARGE_ROWS, at quantiles of their order: from SEGMENTS to MOST_SEGMENTS of them.
SEGMENTS, MOST_SEGMENTS = 64, 4096


def segmented(rows: DataFrame, group: list[str], at: str) -> tuple[DataFrame, bool]:
    """``rows`` with ``segment``: -1 in ordinary groups, the number of a stretch of ``at`` in large ones; whether there are large ones.

    There are at most 512 large groups, or one for every LARGE_ROWS rows; their keys are broadcast. The bounds of stretches are fewer than
    MOST_SEGMENTS values of ``at``, equal values of which stay together. Reads ``rows`` three times, and only ``group``
    and ``at`` of them; store them first if they are costly to make.
    """
    counts = rows.groupBy(*group).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    twins = [f"_{c}" for c in group]
    many = max(1, min(total * LARGE_SHARE, LARGE_ROWS))
    large = counts.where(F.col("count") > many).select(*[F.col(c).alias(t) for c, t in zip(group, twins)], F.lit(True).alias("is_large"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(t)) for c, t in zip(group, twins)])
    marked = rows.join(F.broadcast(large), same, "left").drop(*twins)
    shares = F.lit(np.arange(1, MOST_SEGMENTS) / MOST_SEGMENTS)
    found = marked.where("is_large").agg(F.count("*"), F.percentile_approx(at, shares)).first()
    if not found[0]:
        return marked.drop("is_large").withColumn("segment", F.lit(-1)), False
    wanted = max(SEGMENTS, min(MOST_SEGMENTS, found[0] // LARGE_ROWS))
    bounds = sorted({found[1][i * MOST_SEGMENTS // wanted - 1] for i in range(1, wanted)})
    return marked.withColumn("segment", F.when(F.col("is_large"), _at_most(bounds, F.col(at))).otherwise(-1)).drop("is_large"), True


def _at_most(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most a value, looked up in two steps of some 64 comparisons."""
    parts = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    part = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda b: b <= value))
    inside = F.size(F.filter(F.get(F.array(*[F.lit(p) for p in parts]), part - 1), lambda b: b <= value))
    return F.when(part == 0, 0).otherwise((part - 1) * 64 + inside)


def carried(rows: DataFrame, group: list[str], order: list[str], state: list[str]) -> DataFrame:
    """(group, segment, state): for each stretch of a large group the state of its last row before that stretch, if there is one."""
    last = F.max_by(F.struct(*state), F.struct(*order)).alias("last")
    tails = rows.where("segment >= 0").groupBy(*group, "segment").agg(last)
    by_segment = Window.partitionBy(*group).orderBy("segment")  # at most MOST_SEGMENTS rows a group
    return tails.select(*group, "segment", F.lag("last").over(by_segment).alias("last")).where("last is not null").select(*group, "segment", "last.*")

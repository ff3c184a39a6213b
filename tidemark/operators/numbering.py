"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

LOCAL_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str, path: str) -> DataFrame:
    """``rows`` with their numbers from 0 in ``order``, as column ``name``.

    Rows are sorted by range and stored at ``path`` with their place in their partition; each partition begins at the sum of the
    counts before it, and there is one count per partition.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(spread.withColumn("_id", F.monotonically_increasing_id()), path)
    part = F.shiftright("_id", LOCAL_BITS)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per partition
    return placed.select(*rows.columns, (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).alias(name))

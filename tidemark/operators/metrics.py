"""Counters, rates and histograms of a pipeline's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (first bound, number of bounds) of the histograms of query, flush and insert seconds and of batch sizes; each bound is twice the one before.
QUERY_SECONDS, FLUSH_SECONDS, INSERT_SECONDS, BATCH_SIZE = (0.125, 12), (0.125, 9), (0.125, 12), (1.0, 13)


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def bounds(first: float, count: int) -> list[float]:
    return [first * 2**k for k in range(count)]


def histogram(events: DataFrame, value: str, first: float, count: int, labels: list[str] | None = None) -> DataFrame:
    """(labels, le, n): how many values are at most each bound. All bounds are counted in one pass, each event once."""
    steps = bounds(first, count)
    totals = events.groupBy(*(labels or [])).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(steps)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(steps)])
    return totals.select(*(labels or []), F.explode(pairs).alias("p")).select(*(labels or []), "p.le", "p.n")


def rates(events: DataFrame, at: str, unit: str, seconds: float, labels: list[str]) -> DataFrame:
    """Events per second by label in each hour, minute and so on."""
    start = F.date_trunc(unit, F.col(at)).cast(events.schema[at].dataType)
    return events.groupBy(start.alias("w"), *labels).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))


def bucket_rates(events: DataFrame, at: str, unit: str, seconds: float, value: str, first: float, count: int) -> DataFrame:
    """(w, le, rate): the histogram of each hour, minute and so on, per second."""
    dated = events.withColumn("w", F.date_trunc(unit, F.col(at)).cast(events.schema[at].dataType))
    return histogram(dated, value, first, count, ["w"]).select("w", "le", (F.col("n") / F.lit(float(seconds))).alias("rate"))


def quantiles(events: DataFrame, value: str, shares: list[float], labels: list[str], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles by label."""
    return events.groupBy(*labels).agg(*[F.percentile_approx(value, s, accuracy).alias(f"p{round(100 * s)}") for s in shares])


def histogram_quantile(buckets: DataFrame, share: float, labels: list[str]) -> DataFrame:
    """A quantile read from a histogram by interpolation in the bucket where it falls; the largest bound beyond the last."""
    pairs = F.sort_array(F.collect_list(F.struct("le", "n")))  # a fixed number of bounds
    grouped = buckets.groupBy(*labels).agg(pairs.alias("b"))
    rank = F.element_at("b", -1)["n"] * share
    at = F.coalesce(F.array_position(F.transform("b", lambda x: x["n"] >= rank), F.lit(True)), F.lit(1)).cast("int")
    high, low = F.element_at("b", at), F.get("b", at - 2)
    low_le, low_n = F.coalesce(low["le"], F.lit(0.0)), F.coalesce(low["n"], F.lit(0))
    value: Column = low_le + (high["le"] - low_le) * F.coalesce(F.try_divide(rank - low_n, high["n"] - low_n), F.lit(0.0))
    return grouped.select(*labels, value.alias("value"))

"""Queries of the text problems (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import workspace
from ..plans.tables import dealt, table
from .leaks import find_leaks
from .mixture import Mixture
from .quality import held_out, shapes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat a held-out item, wholly or partly."""
    return find_leaks(dealt(spark, d, "documents", "doc_id", "docket_no", "text"), table(spark, d, "bench_items"), workspace(spark, "leaks")).select("item_id", "doc_id")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(dealt(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"), workspace(spark, "mixture"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The copies of documents that make up the mix, by shard and place."""
    return _mixture(spark, d).drawn()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the sources that the mix reaches."""
    return _mixture(spark, d).report()


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return shapes(dealt(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words"), table(spark, d, "doc_labels"), workspace(spark, "quality"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not prose, with their shape."""
    return _shapes(spark, d).where("shape <> 'prose'").select("doc_id", "shape")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document, its shape and how sure that is."""
    return _shapes(spark, d)


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How far the shapes agree with hand labels that the model has not seen."""
    return held_out(dealt(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words"), table(spark, d, "doc_labels"), workspace(spark, "quality"))


QUERIES = {"p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_held_out": p8_held_out}
SQL: dict[str, str] = {}

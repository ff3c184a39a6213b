import os

import pytest

import __spark_entry__ as entry
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())


def test_leaks(spark):
    found = QUERIES["p6_found"](spark, DATA)
    assert found.columns == ["item_id", "doc_id"] and found.distinct().count() == found.count() > 0


def test_mix(spark):
    mix, shares = QUERIES["p7_mix"](spark, DATA), QUERIES["p7_shares"](spark, DATA)
    assert shares.count() == 8 and mix.count() > 0
    assert shares.where("tokens > quota or most_repeats > max_repeats").isEmpty()


def test_shapes(spark):
    found = QUERIES["p8_found"](spark, DATA)
    assert found.columns == ["doc_id", "shape"] and found.where("shape not in ('list', 'table', 'junk')").isEmpty()
    assert QUERIES["p8_statistics"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()

import os

import pytest

from tests.damage import damaged
from tests.duck import DATA, spark_rows
from tidemark.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module", params=["empty", "nulls", "clashes"])
def tables(request, tmp_path_factory):
    return request.param, damaged(DATA, str(tmp_path_factory.mktemp("d") / request.param), request.param)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_over_damaged_tables(spark, tables, name):
    how, folder = tables
    rows = spark_rows(QUERIES[name](spark, folder))
    if how == "empty":
        assert rows[1] == []
    if how == "clashes":
        assert rows == spark_rows(QUERIES[name](spark, DATA))

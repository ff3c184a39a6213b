import pytest

from tidemark.operators import control
from tidemark.operators.changelog import last_lsn
from tidemark.operators.imports import NoPrimaryKey, SeveralPrimaryKeys
from tidemark.sources import catalog
from tidemark.streaming.instrument import Measurements, Timed

from .test_imports import NOW, job, jobs


@pytest.fixture(scope="module")
def pg(spark):
    classes = spark.createDataFrame([(1, "one", 10), (2, "composite", 10), (3, "keyless", 10), (4, "one", 11)], "oid int, relname string, relnamespace int")
    namespaces = spark.createDataFrame([(10, "public"), (11, "other")], "oid int, nspname string")
    attributes = spark.createDataFrame(
        [(1, 2, "msg", 25, 7, False), (1, 1, "id", 20, -1, False), (1, -1, "ctid", 27, -1, False), (1, 3, "gone", 25, -1, True), (2, 1, "id", 20, -1, False), (2, 2, "msg", 25, -1, False), (3, 1, "id", 20, -1, False), (4, 1, "x", 25, -1, False)],
        "attrelid int, attnum int, attname string, atttypid int, atttypmod int, attisdropped boolean",
    )
    indexes = spark.createDataFrame([(1, [1], True), (1, [2], False), (2, [2, 1], True), (4, [1], True)], "indrelid int, indkey array<int>, indisprimary boolean")
    return classes, namespaces, attributes, indexes


def test_schemas_and_keys(pg):
    found = catalog.schemas(*pg)
    one = found.where("namespace = 'public' and name = 'one'").first()
    assert [tuple(c) for c in one["columns"]] == [(True, "id", 20, 0), (False, "msg", 25, 0)]
    assert catalog.primary_key(found, "public", "one") == "id" and catalog.primary_key(found, "other", "one") == "x"
    with pytest.raises(SeveralPrimaryKeys, match="id, msg"):
        catalog.primary_key(found, "public", "composite")
    with pytest.raises(NoPrimaryKey):
        catalog.primary_key(found, "public", "keyless")
    with pytest.raises(LookupError):
        catalog.primary_key(found, "public", "absent")


def test_tables_of_equal_names_stay_apart(spark, pg):
    information = spark.createDataFrame([("public", "one", "BASE TABLE"), ("other", "one", "BASE TABLE"), ("public", "composite", "VIEW")], "table_schema string, table_name string, table_type string")
    got = sorted(tuple(r) for r in catalog.tables(information, *pg[:2]).collect())
    assert got == [("other", "one", 4), ("public", "one", 1)]


def test_jobs_by_table_and_search(spark):
    rows = control.jobs_by_table(jobs(spark, job(1), job(2, created_at=NOW.replace(year=2025)), job(3, table="x"))).collect()
    assert {r["table_name"]: [j["id"] for j in r["jobs"]] for r in rows} == {"two": [2, 1], "x": [3]}
    tables = spark.createDataFrame([("p", "Orders"), ("p", "order_lines"), ("p", "ordres"), ("p", "dogs")], "schema string, table_name string")
    assert sorted(r["table_name"] for r in control.search(tables, "order").collect()) == ["Orders", "order_lines", "ordres"]


def test_last_lsn(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "at int, lsn bigint")
    assert last_lsn(df, "at").first()["lsn"] == 9 and last_lsn(df.limit(0), "at").first()["lsn"] is None


def test_measurements(spark, tmp_path):
    listener, seen = Measurements(), []
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        timed = Timed(lambda df, n: seen.append(df.count()), "r")
        query = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.queryName("timed").foreachBatch(timed).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert seen == [5] and len(timed.seconds["r"]) == 1
    rows = [b for b in listener.batches if b[2]]
    assert [(b[0], b[2]) for b in rows] == [("timed", 5)] and listener.frame(spark).count() == len(listener.batches)
    with pytest.raises(ZeroDivisionError):
        Timed(lambda df, n: 1 / 0, "bad")(None, 0)

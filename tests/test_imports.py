from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import imports
from tidemark.operators.imports import JOB, ImportOptions, ImportWorker, NoPrimaryKey, SeveralPrimaryKeys, import_table

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def job(n=1, cursor=None, sub="s", table="two", **more):
    row = dict.fromkeys(JOB.fieldNames()) | {"id": n, "subscription_id": sub, "schema": "public", "table_name": table, "cursor": cursor, "created_at": NOW, "updated_at": NOW, "error_count": 0, "rows_processed_total": 0} | more
    return tuple(row[c] for c in JOB.fieldNames())


def jobs(spark, *rows):
    return imports.jobs_frame(spark, list(rows))


def two(spark, n):
    return spark.range(1, n + 1).select("id", F.concat(F.lit("m"), "id").alias("message"))


def run(spark, n, limit=1000, clock=None, **more):
    got = []
    outcome = import_table(two(spark, n), "id", jobs(spark, job(**more)).first(), lambda df: got.append(df.collect()), ImportOptions(limit), clock or (lambda: NOW))
    return outcome, got


def test_empty_short_and_full_pages(spark):
    assert run(spark, 0)[0] == imports.Outcome(0, None, True)
    outcome, got = run(spark, 2)
    assert outcome == imports.Outcome(2, "2", True) and len(got) == 1
    assert got[0][0].asDict() == {"timestamp": datetime(2024, 1, 1), "namespace": "public", "name": "two", "lsn": None, "sequence": None, "before": None, "after": '{"id":1,"message":"m1"}'}
    outcome, got = run(spark, 20, limit=10)  # a full last page needs one more, empty one
    assert outcome == imports.Outcome(20, "20", True) and [len(x) for x in got] == [10, 10]
    outcome, got = run(spark, 21, limit=10)
    assert outcome.complete and [len(x) for x in got] == [10, 10, 1]


def test_goes_on_from_the_cursor_and_stops_when_time_is_up(spark):
    outcome, got = run(spark, 20, limit=10, cursor="15")
    assert outcome == imports.Outcome(5, "20", True) and got[0][0]["after"] == '{"id":16,"message":"m16"}'
    times = iter([NOW, NOW, NOW + timedelta(minutes=2), NOW + timedelta(minutes=3), NOW])
    outcome, _ = run(spark, 50, limit=10, clock=lambda: next(times))
    assert outcome == imports.Outcome(10, "10", False)
    assert run(spark, 5, cursor="")[0] == imports.Outcome(5, "5", True)
    assert run(spark, 5, cursor="99")[0] == imports.Outcome(0, "99", True)


def test_cursor_types_and_keys():
    assert imports.typed_cursor("1", T.LongType()) == 1 and imports.typed_cursor("PM123", T.StringType()) == "PM123"
    assert imports.typed_cursor("", T.LongType()) is None and imports.typed_cursor(None, T.StringType()) is None
    assert imports.typed_cursor("1.5", T.DoubleType()) == 1.5 and imports.typed_cursor("2024-01-01", T.TimestampType()) == datetime(2024, 1, 1)
    assert imports.key_column([("id", True), ("msg", False)]) == "id"
    with pytest.raises(NoPrimaryKey):
        imports.key_column([("id", False)])
    with pytest.raises(SeveralPrimaryKeys, match="id, msg"):
        imports.key_column([("msg", True), ("id", True)])


def test_page_pushes_the_cursor_into_the_scan(spark, at):
    two(spark, 100).write.parquet(f"{at}/two")
    plan = imports.page(spark.read.parquet(f"{at}/two"), "id", 50, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "TakeOrderedAndProject" in plan
    assert imports.backfill(spark.read.parquet(f"{at}/two"), "id", 50, "public", "two", NOW).count() == 50


def test_which_jobs_can_run(spark):
    late, soon = NOW - timedelta(hours=2), NOW - timedelta(seconds=10)
    all_jobs = jobs(
        spark, job(1, completed_at=NOW), job(2, expired_at=NOW), job(3, sub="other"), job(4, error="x", error_count=2, last_error_at=soon), job(5, error="x", error_count=20, last_error_at=late),
        job(6), job(7), job(8, error="x", error_count=1, last_error_at=None),
    )
    assert [r["id"] for r in imports.runnable(all_jobs, "s", NOW).collect()] == [6, 7, 5]
    assert imports.acquire(all_jobs, "s", NOW)["id"] == 6 and imports.acquire(all_jobs, "s", NOW, {6, 7})["id"] == 5
    assert imports.acquire(all_jobs, "nobody", NOW) is None


def test_reconcile_creates_what_is_missing(spark):
    published = spark.createDataFrame([("public", "one"), ("public", "two"), ("public", "three"), ("public", "three")], "schema string, table_name string")
    had = jobs(spark, job(7, table="one"), job(8, table="two", expired_at=NOW), job(9, table="three", sub="other"))
    missing = imports.missing_jobs(published, had, "s")
    made = imports.create_jobs(had, missing, "s", NOW)
    assert sorted((r["id"], r["table_name"]) for r in made.where("id > 9").collect()) == [(10, "three"), (11, "two")]
    assert imports.missing_jobs(published, made, "s").count() == 0


def test_outcomes(spark):
    had = jobs(spark, job(1, error="x", error_count=3, rows_processed_total=5), job(2))
    done = imports.succeeded(had, 1, imports.Outcome(10, "15", True), NOW).where("id = 1").first()
    assert (done["error"], done["error_count"], done["cursor"], done["rows_processed_total"]) == (None, 0, "15", 15) and done["completed_at"]
    assert imports.succeeded(had, 1, imports.Outcome(10, "15", False), NOW).where("completed_at is not null").count() == 0
    bad = imports.failed(had, 1, "no", NOW)
    assert tuple(bad.where("id = 1").select("error", "error_count").first()) == ("no", 4) and bad.where("id = 2").first()["error"] is None
    assert imports.expired(jobs(spark, job(1), job(2, table="x"), job(3, completed_at=NOW)), "s", "public", "two", NOW).where("expired_at is not null").count() == 2


def test_worker_from_jobs_to_rows(spark, at):
    got = []
    sources = {"two": two(spark, 25)}
    worker = ImportWorker(spark, at, "s", lambda schema, table: (sources[table], "id"), lambda df: got.append(df.count()), ImportOptions(10))
    worker.save(jobs(spark, job(1), job(2, table="missing")))
    assert worker.work(lambda: NOW, most=10) == 2 and got == [10, 10, 5]
    rows = {r["id"]: r for r in worker.jobs().collect()}
    assert rows[1]["completed_at"] and rows[1]["cursor"] == "25" and rows[2]["error_count"] == 1 and "missing" in rows[2]["error"]
    assert worker.work(lambda: NOW + timedelta(seconds=1)) == 0  # the failed one waits

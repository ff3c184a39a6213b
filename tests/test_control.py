from datetime import datetime, timedelta

from tidemark.operators import control, metrics
from tidemark.operators.imports import JOB

from .test_imports import NOW, job, jobs


def names(df):
    return sorted(tuple(r) for r in df.select("schema", "table_name").collect())


def tables(spark, *pairs):
    return spark.createDataFrame(list(pairs), "schema string, table_name string")


def test_sets_of_tables(spark):
    a, b = tables(spark, ("p", "x"), ("p", "y"), ("q", "x"), ("p", "x")), tables(spark, ("p", "y"), ("p", "z"))
    assert names(control.difference(a, b)) == [("p", "x"), ("q", "x")] and names(control.difference(b, a)) == [("p", "z")]
    assert names(control.included(a, b)) == [("p", "y")]
    assert sorted(tuple(r) for r in control.reconcile(a, b).collect()) == [("p", "x", "add"), ("p", "z", "remove"), ("q", "x", "add")]
    assert names(control.add_table(b, "p", "z")) == names(b) and ("n", "n") in names(control.add_table(b, "n", "n"))
    assert names(control.remove_table(b, "p", "z")) == [("p", "y")]
    assert control.reconcile(a, a).count() == 0


def test_watched_tables(spark):
    a = tables(spark, ("p", "x"), ("p", "y"), ("q", "x"))
    assert names(control.watched(a)) == names(a)
    assert names(control.watched(a, ["p"])) == [("p", "x"), ("p", "y")]
    assert names(control.watched(a, ["p", "q"], ["p.x", "q.x"], ["q.x"])) == [("p", "x")]
    assert names(control.watched(a, [], [], ["x"])) == names(a)


def test_publications(spark):
    publications = spark.createDataFrame([("pub", "id1"), ("other", "id2")], "name string, id string")
    members = spark.createDataFrame([("pub", "p", "x"), ("other", "p", "y")], "publication string, schema string, table_name string")
    assert control.find_publication(publications, "pub").first()["id"] == "id1" and control.find_publication(publications, "no").count() == 0
    assert names(control.published_tables(publications, members, "pub")) == [("p", "x")]


def test_table_list(spark):
    later = NOW + timedelta(hours=1)
    all_tables = tables(spark, *[("public", x) for x in ("larry", "moe", "curly", "shemp", "joe", "ted")], ("other", "larry"))
    published = tables(spark, ("public", "larry"), ("public", "moe"))
    rows = jobs(
        spark, job(1, table="larry"), job(2, table="moe", expired_at=NOW, rows_processed_total=9), job(3, table="moe", completed_at=NOW, created_at=later, rows_processed_total=7),
        job(4, table="curly", error="bad"), job(5, table="shemp", cursor="5", rows_processed_total=3), job(6, table="joe", expired_at=NOW, rows_processed_total=9), job(7, table="ted", sub="other"),
    )
    got = control.table_list(all_tables, published, rows, "s", ["public"]).collect()
    assert [(r["table_name"], r["publication_status"], r["import_status"], r["rows_processed_total"]) for r in got] == [
        ("curly", "inactive", "error", 0), ("joe", "inactive", "expired", 0), ("larry", "active", "scheduled", 0), ("moe", "active", "complete", 7), ("shemp", "inactive", "in_progress", 3), ("ted", "inactive", "inactive", 0),
    ]
    assert control.table_list(all_tables, published, rows, "s").count() == 7


def test_newest_job_of_equal_times_is_the_first(spark):
    assert [r["id"] for r in control.newest_jobs(jobs(spark, job(2), job(1))).collect()] == [1]
    assert set(control.newest_jobs(jobs(spark)).columns) == set(JOB.fieldNames())


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("some_view")
    listed = control.catalog_tables(spark)
    assert ("some_view",) in [(r["table_name"],) for r in listed.collect()]
    assert ("some_view",) not in [(r["table_name"],) for r in control.base_tables(listed).collect()]
    assert control.relation_columns(spark.range(1)) == [("id", "bigint")]


def test_metrics(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, i), v) for i, v in enumerate((0.1, 0.125, 0.3, 5.0, 600.0))] + [("b", datetime(2024, 1, 1, 2), None)], "l string, ts timestamp_ntz, v double")
    counts = {r["le"]: r["n"] for r in metrics.histogram(df, "v", *metrics.QUERY_SECONDS).collect()}
    assert len(counts) == 12 and counts[0.125] == 2 and counts[0.25] == 2 and counts[0.5] == 3 and counts[256.0] == 4
    assert {r["l"]: r["n"] for r in metrics.counters(df, ["l"]).collect()} == {"a": 5, "b": 1}
    rates = {(r["w"].hour, r["l"]): r["rate"] for r in metrics.rates(df, "ts", "hour", 3600, ["l"]).collect()}
    assert rates == {(0, "a"): 5 / 3600, (2, "b"): 1 / 3600}
    assert metrics.bucket_rates(df, "ts", "hour", 3600, "v", *metrics.FLUSH_SECONDS).count() == 18
    assert {r["l"]: r["p50"] for r in metrics.quantiles(df, "v", [0.5], ["l"]).collect()} == {"a": 0.3, "b": None}
    got = {r["l"]: r["value"] for r in metrics.histogram_quantile(metrics.histogram(df, "v", 1.0, 13, ["l"]), 0.5, ["l"]).collect()}
    assert got["a"] == 2.5 / 3 and got["b"] == 0.0

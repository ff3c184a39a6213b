from datetime import datetime, timezone

from tidemark.api import Options, Subscription
from tidemark.operators.imports import ImportOptions
from tidemark.sources import replication
from tidemark.sources.pgoutput import encode_message

from .test_changelog import LOG


def subscription(spark, at):
    tables = spark.createDataFrame([("public", "dogs"), ("public", "two"), ("other", "dogs")], "schema string, table_name string")
    return Subscription(spark, at, "sub", tables, Options(imports=ImportOptions(10)), lambda: datetime(2024, 1, 1, tzinfo=timezone.utc))


def names(df):
    return sorted(tuple(r)[:2] for r in df.collect())


def test_tables_and_imports(spark, at):
    s = subscription(spark, at)
    assert s.health() == "healthy" and names(s.published()) == []
    assert names(s.reconcile(["public"], excludes=["public.dogs"])) == [("public", "two")]
    assert names(s.reconcile(["public"], excludes=["public.dogs"])) == []
    assert names(s.add_table("public", "dogs")) == [("public", "dogs"), ("public", "two")]
    assert names(s.reconcile_imports()) == [("public", "dogs"), ("public", "two")] and names(s.reconcile_imports()) == []
    assert s.run_imports(lambda schema, table: (spark.range(15), "id") if table == "two" else 1 / 0) == 2
    assert s.imported().count() == 15
    status = {r["table_name"]: (r["publication_status"], r["import_status"], r["rows_processed_total"]) for r in s.list_tables("public").collect()}
    assert status == {"two": ("active", "complete", 15), "dogs": ("active", "error", 0)}
    assert names(s.stop_table("public", "dogs")) == [("public", "two")]
    assert {r["table_name"]: r["expired_at"] is not None for r in s.list_imports().collect()} == {"two": False, "dogs": True}
    assert names(s.reconcile([], ["none.such"])) == [("public", "two")] and names(s.published()) == []


def test_stream_into_tables(spark, at, tmp_path):
    recording, acked = str(tmp_path / "log"), []
    messages = [(i, encode_message(m)) for i, m in enumerate(LOG[:15])] + [(15, encode_message(LOG[16]))]
    replication.record(recording, "s", messages[:9])
    s = subscription(spark, at)
    s.start(recording, drain=True, ack=acked.append)
    assert acked == [11]
    replication.record(recording, "s", messages[9:])
    s = subscription(spark, at)
    s.start(recording, drain=True, ack=acked.append)
    assert acked[-1] == 31
    assert sorted((r["id"], r["msg"], r["note"]) for r in s.raw.latest("public.dogs").collect()) == [(1, None, None), (3, None, "b")]
    assert [r["id"] for r in s.raw.latest("other.dogs").collect()] == [1]

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pgtypes
from tidemark.operators import changelog
from tidemark.sinks import files
from tidemark.sinks.raw_tables import BatchSink, RawTables, TableSchema

from .test_changelog import LOG, begin, cells, commit, decoded, relation

SPEC = json.dumps({"columns": [{"key": True, "name": "id", "type": 20}, {"name": "born", "type": "date"}, {"name": "tags", "type": 1009}]})


def entries(spark, messages):
    return changelog.entries(decoded(spark, messages))


def test_schema_of_a_spec():
    s = TableSchema.of("public", "dogs", SPEC)
    assert s.columns == (("id", 20, True), ("born", 1082, False), ("tags", 1009, False)) and s.key == ["id"] and s.reference == "public.dogs"
    assert pgtypes.TYPES[1082][0] == "date"


def test_raw_tables_and_latest_rows(spark, at):
    tables = RawTables(spark, at)
    assert tables.register(TableSchema.of("public", "dogs", SPEC)) == "update" and tables.register(TableSchema.of("public", "dogs", SPEC)) == "noop"
    rows = spark.createDataFrame(
        [
            (datetime(2024, 1, 1), 1, 1, "I", None, {"id": "1", "born": "2020-02-02", "tags": '{a,"b c"}'}),
            (datetime(2024, 1, 1), 1, 2, "U", None, {"id": "1", "born": None, "tags": "{}"}),  # one transaction: the sequence decides
            (datetime(2024, 1, 2), 2, 1, "D", {"id": "2"}, None),
            (datetime(2024, 1, 2), None, None, None, None, {"id": "3", "born": "2021-01-01"}),
        ],
        "timestamp timestamp, lsn bigint, sequence bigint, message_type string, before map<string,string>, after map<string,string>",
    )
    for _ in range(2):  # a repeated batch replaces its files
        tables.append("public.dogs", rows, 0)
    raw = tables.raw("public.dogs")
    assert [f.name for f in raw.schema["payload"].dataType.fields] == ["born", "id", "tags"]
    assert sorted(r["operation"] for r in raw.collect()) == ["DELETE", "IMPORT", "INSERT", "UPDATE"]
    assert sorted((r["id"], r["born"], r["tags"]) for r in tables.latest("public.dogs").collect()) == [(1, None, []), (3, date(2021, 1, 1), None)]
    pruned = raw.where("date = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in pruned
    assert RawTables(spark, at).schemas == tables.schemas  # found again by another session
    assert tables.create_views() == ["public_dogs"] and spark.table("public_dogs").count() == 2


def test_batch_sink_routes_by_table_and_schema(spark, at):
    acked = []
    sink = BatchSink(RawTables(spark, at), acked.append)
    found = entries(spark, LOG[:13])
    acks = found.limit(1).select([F.lit("ack" if c == "kind" else 21 if c == "lsn" else None).cast(found.schema[c].dataType).alias(c) for c in found.columns])
    for _ in range(2):
        sink(found.unionByName(acks), 0)
    assert acked == [21, 21] and sorted(sink.tables.schemas) == ["other.dogs", "public.dogs"]
    assert [len(sink.tables.schemas[x]) for x in ("other.dogs", "public.dogs")] == [1, 2]
    raw = sink.tables.raw("public.dogs")
    assert sorted(raw.schema["payload"].dataType.fieldNames()) == ["id", "msg", "note"]
    assert sorted((r["payload"]["id"], r["payload"]["msg"], r["payload"]["note"], r["operation"]) for r in raw.collect() if r["payload"]["note"]) == [(3, None, "b", "UPDATE")]
    assert sink.tables.latest("other.dogs").count() == 1
    with pytest.raises(ValueError, match="before any schema"):
        BatchSink(RawTables(spark, f"{at}/new"))(found.where("kind = 'modification'"), 0)
    sink(found.limit(0), 1)


def test_schema_that_goes_and_comes_back(spark, at):
    tables = RawTables(spark, at)
    log = [begin(1), relation(1, "t", "id", "a"), commit(1), begin(2), relation(1, "t", "id", "b"), commit(2), begin(3), relation(1, "t", "id", "a"), {"msg_type": "I", "relation_id": 1, "row": cells("1", "x")}, commit(3)]
    BatchSink(tables)(entries(spark, log), 0)
    assert len(tables.schemas["public.t"]) == 3
    assert [r.asDict() for r in tables.latest("public.t").collect()] == [{"a": "x", "b": None, "id": 1}]


def test_json_files(spark, at, tmp_path):
    found = entries(spark, LOG[:13])
    assert files.write_json(found, f"{at}/out") == (8, 20)
    assert files.write_json(found, f"{at}/out") == (8, 20)
    assert spark.read.json(f"{at}/out").count() == 16
    text = found.where("kind = 'modification'").orderBy("position").select(files.serialized(["name", "lsn", "after"], pretty=True).alias("j"), files.serialized(["name", "before"]).alias("s")).first()
    assert "\n" in text["j"] and json.loads(text["j"]) == {"name": "dogs", "lsn": 10, "after": {"id": "1", "msg": "a"}} and text["s"] == '{"name":"dogs"}'
    source = spark.readStream.schema("name string, lsn bigint").json(f"{at}/out")
    query = files.stream_json(source, f"{at}/copy", f"{at}/c", None)
    query.awaitTermination()
    assert spark.read.json(f"{at}/copy").count() == 16


def test_memory_sink(spark):
    sink = files.MemorySink()
    found = entries(spark, LOG[:13])
    sink(found.where("lsn = 20"), 0)
    sink(found.where("lsn = 10"), 1)
    sink(found.limit(0), 2)
    assert sink.lsn == 20 and len(sink.rows) == 8 and [len(b) for b in sink.batches] == [5, 3, 0]

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.images import entries_json
from tidemark.operators import segments
from tidemark.operators.history import HistoryStore
from tidemark.operators.row_events import row_events, with_keys

from .capture import DOGS, MODIFICATIONS, SCHEMAS, change, random_log, schema_entry, us, versions


@pytest.fixture(params=[1 / 512, 2.0], ids=["stretches", "whole"])
def large_share(request, monkeypatch):
    monkeypatch.setattr(segments, "LARGE_SHARE", request.param)
    monkeypatch.setattr(segments, "SEGMENTS", 5)


def store(spark, at, rows, every=3, batches=1, schema=DOGS):
    h = HistoryStore(spark, f"{at}/h", every)
    for i in range(batches):
        mods = spark.createDataFrame(rows[i::batches], MODIFICATIONS)
        h.apply(row_events(with_keys(mods, spark.createDataFrame([schema], SCHEMAS), f"{at}/k{i}")))
    return h


def steps(h):
    return h.chains().withColumn("n", F.size("steps")).select("row_key", "since", "upto", "n", F.explode("steps").alias("s")).select("row_key", "since", "upto", "n", "s.*")


def found(h):
    rows = h.versions().withColumn("attributes", entries_json(F.col("attributes"))).collect()
    return sorted((r["namespace"], r["name"], r["row_key"], r["valid_from"], r["valid_to"], tuple(sorted(json.loads(r["attributes"]).items()))) for r in rows)


@pytest.mark.parametrize("seed, batches", [(0, 1), (1, 1), (2, 3)])
def test_against_plain_python(spark, at, seed, batches, large_share):
    rows = random_log(random.Random(seed), 80, keys=3)
    h = store(spark, at, rows, batches=batches)
    assert found(h) == versions(rows)
    assert h.manifest()["version"] == batches
    for t in (0, 7, 20, 45):
        then = sorted((r["namespace"], r["name"], r["row_key"], tuple(sorted((e["key"], e["value"]) for e in r["attributes"]))) for r in h.as_of(us(t)).collect())
        assert then == sorted((*v[:3], v[5]) for v in versions(rows) if v[3] <= us(t) and (us(t) < v[4] or v[4] == 0))


def test_only_touched_buckets_are_written(spark, at):
    rows = [change(i, i, i + 1, None, {"id": i, "msg": "a"}) for i in range(40)]
    h = store(spark, at, rows)
    before = h.manifest()["files"]
    late = [change(100, 3, 4_000, None, {"id": 3, "msg": "late"}), change(101, 1, 4_001, None, {"id": 3, "msg": "early"})]
    h.apply(row_events(with_keys(spark.createDataFrame(late, MODIFICATIONS), spark.createDataFrame([DOGS], SCHEMAS), f"{at}/k9")))
    after = h.manifest()["files"]
    assert len(before) > 2 and sum(before[b] != after[b] for b in before) == 1
    assert found(h) == versions(rows + late)
    assert h.apply(row_events(with_keys(spark.createDataFrame([], MODIFICATIONS), spark.createDataFrame([DOGS], SCHEMAS), f"{at}/k10"))) == 2


def test_composite_keys(spark, at):
    two = schema_entry(1, 0, 1, [("id", 20, True), ("part", 25, True), ("msg", 25)])
    rows = [change(i, i, i + 1, None, {"id": 1, "part": p, "msg": "m"}) for i, p in enumerate(["a", "b", "c"])] + [change(9, 9, 9, None, {"id": 1, "part": None})]
    assert [r[2:5] for r in found(store(spark, at, rows, schema=two))] == [(f'["1","{p}"]', us(i), 0) for i, p in enumerate("abc")]


def test_folded_from_the_nearest_checkpoint(spark, at, large_share):
    rows = [change(i, i, i + 1, None, {"id": 1, "msg": str(i), "big": "same " * 50}) for i in range(20)]
    h = store(spark, at, rows, every=4)
    kinds = {r["kind"]: r["count"] for r in steps(h).groupBy("kind").count().collect()}
    assert kinds["full"] + kinds["patch"] == 20 and kinds["full"] <= 5 + 5 and kinds["patch"] >= 10
    patch = steps(h).where("kind = 'patch'").first()
    assert [e["key"] for e in patch["set"]] == ["msg"] and patch["unset"] == []
    assert steps(h).agg(F.max("n")).first()[0] <= 4
    assert found(h) == versions(rows)


def test_what_is_one_version(spark, at, large_share):
    rows = [
        change(1, 1, 1, None, {"id": 1, "msg": "a", "another": None}),
        change(2, 1, 1, None, '{ "another":null,"msg": "a", "id": "1" }'),  # a copy, other spelling
        change(3, 2, 2, None, {"id": "1", "msg": "a"}),  # a string equals the same bare value
        change(4, 3, 3, None, {"id": 1, "msg": "b"}),
        change(5, 3, 4, None, {"id": 1, "msg": "a"}),  # the last of its time
        change(6, 4, 5, {"id": 1}, None),
        change(7, 4, 6, None, {"id": 1, "msg": "a"}),  # deleted and there again at one time
        change(8, 6, 7, {"id": 1}, "null"),
        change(9, 7, 8, None, {"id": 1, "msg": "a"}),  # as before, but after an end
    ]
    got = [r[3:5] for r in found(store(spark, at, rows))]
    assert got == [(us(1), us(6)), (us(7), 0)]


def test_empty_null_and_long(spark, at):
    assert found(store(spark, at, [])) == []
    rows = [change(1, 1, 1, None, {"id": 1, "msg": "x" * 1_000_000}), change(2, 2, 2, None, "junk"), change(3, 3, 3, None, None), change(4, 4, 4, {"id": 9}, None), change(5, 5, 5, None, {"id": 2}, name=None)]
    assert [r[2:5] for r in found(store(spark, f"{at}/2", rows))] == [("1", us(1), 0)]


def test_no_task_gets_a_large_history(spark, at, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS", 10)
    h = store(spark, at, [change(i, i, i + 1, None, {"id": 1, "msg": str(i)}) for i in range(200)] + [change(1000, 5, 9999, None, {"id": 2})])
    # Each stretch begins a chain of its own.
    sizes = [r["n"] for r in h.chains().where("row_key = '1'").select(F.size("steps").alias("n")).collect()]
    assert sum(sizes) == 200 and len(sizes) >= 10 and max(sizes) <= 25
    assert h.versions().count() == 201

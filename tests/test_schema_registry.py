import pytest

from tidemark.operators import segments
from tidemark.operators.schema_registry import SchemaRegistry, cast_text

from .capture import MODIFICATIONS, SCHEMAS, change, schema_entry

ID = ("id", 20, True)


@pytest.fixture(params=[1 / 512, 2.0], ids=["stretches", "whole"])
def large_share(request, monkeypatch):
    monkeypatch.setattr(segments, "LARGE_SHARE", request.param)


def registry(spark, at, entries):
    return SchemaRegistry(spark.createDataFrame(entries, SCHEMAS).selectExpr("*", "'x' as columns", "'x' as segment"), at)


def steps(spark, at, *entries):
    return sorted((r["lsn"], r["column_name"], r["change"]) for r in registry(spark, at, list(entries)).steps().collect())


def test_each_kind_of_change(spark, at, large_share):
    entries = [
        schema_entry(1, 1, 10, [ID, ("a", 25), ("b", 23)]),
        schema_entry(2, 2, 20, [ID, ("c", "text"), ("b", "int4")]),  # a renamed to c, other spelling of types
        schema_entry(3, 3, 30, [ID, ("c", 25), ("b", 20), ("d", 16)]),  # b retyped, d added
        schema_entry(4, 4, 40, [ID, ("b", 20), ("d", 16), ("c", 25)]),  # only moved
        schema_entry(5, 5, 50, [ID, ("b", 20), ("e", 25)]),  # d and c gone; e stands at the place of d with another type
        schema_entry(6, 6, 60, [ID, ("f", 20), ("e", 25), ("g", 25)]),
    ]
    want = [(20, "c", "renamed"), (30, "b", "retyped"), (30, "d", "added"), (50, "c", "removed"), (50, "d", "removed"), (50, "e", "added"), (60, "f", "renamed"), (60, "g", "added")]
    late = [entries[i] for i in (3, 0, 5, 2, 1, 4)]
    assert steps(spark, at, *late, *entries) == want


def test_what_is_no_case(spark, at, large_share):
    plain = schema_entry(1, 1, 10, [ID, ("a", 25)])
    omitted = schema_entry(2, 2, 20, [{"name": "id", "type": "int8", "key": True}, {"name": "a", "type": "text"}])
    modified = schema_entry(3, 3, 30, [{"name": "id", "type": 20, "key": True, "modifier": 7}, {"name": "a", "type": 25, "key": False, "modifier": 4294967295}])
    imported = schema_entry(4, 4, None, [ID])
    assert steps(spark, at, plain, omitted, modified, imported) == []
    assert steps(spark, f"{at}/none") == []


def test_unreadable_and_null_specs_have_no_columns(spark, at, large_share):
    bad = [(*schema_entry(n, n, n, [ID])[:8], spec) for n, spec in ((2, None), (3, "junk"), (4, "{}"))]
    assert steps(spark, at, schema_entry(1, 1, 1, [ID]), *bad, schema_entry(5, 5, 5, [ID])) == [(2, "id", "removed"), (5, "id", "added")]
    nulls = [(*schema_entry(n, 1, n, [ID, (c, 25)])[:5], None, None, n, schema_entry(n, 1, n, [ID, (c, 25)])[8]) for n, c in ((1, "a"), (2, "b"))]
    assert steps(spark, f"{at}/n", *nulls) == [(2, "b", "renamed")]


def test_many_versions_of_one_table(spark, at, large_share):
    entries = [schema_entry(n, n, n, [ID, (f"c{n}", 25)]) for n in range(1, 41)]
    assert steps(spark, at, *entries) == [(n, f"c{n}", "renamed") for n in range(2, 41)]
    (lineage,) = [r for r in registry(spark, f"{at}/l", entries).lineages().where("column = 'c1'").collect()]
    assert (lineage["final"], lineage["type"]) == ("c40", "text")


def test_images_of_all_versions_in_one_schema(spark, at):
    entries = [
        schema_entry(1, 10, 10, [ID, ("a", 25), ("n", 23)]),
        schema_entry(2, 20, 20, [ID, ("b", 25), ("n", 25)]),
        schema_entry(3, 30, 30, [ID, ("c", 25), ("n", 25), ("a", 16)]),
        schema_entry(4, 40, 40, [ID, ("n", 25), ("a", 16)]),
        schema_entry(5, 50, 50, [ID, ("n", 25), ("a", 16), ("c", 16)]),
    ]
    mods = [
        change(1, 10, 10, None, {"id": 1, "a": "x", "n": 5}),
        change(2, 20, 20, None, {"id": 1, "b": "y", "n": "five"}),
        change(3, 35, 35, {"id": 1, "c": "old", "a": True}, None),
        change(4, 25, None, None, {"id": 1, "b": "z", "n": None}),
        change(5, 60, 60, None, {"id": 1, "a": "maybe", "c": False, "zz": 1}),
        change(6, 60, 61, None, None),
        change(7, 60, 62, None, {"id": 1}, name="unknown"),
    ]
    unified = registry(spark, at, entries).unify(spark.createDataFrame(mods, MODIFICATIONS).selectExpr("*", "'x' as placed", "'x' as misfits"), ["delivery_id"])
    got = {r["delivery_id"]: ({e["key"]: e["value"] for e in r["attributes"]}, r["misfits"]) for r in unified.collect()}
    # c (once a, then b) was removed at 40 and another c stands there in the end.
    assert got[1] == ({"id": "1", "c#40": "x", "n": "5"}, [])
    assert got[2] == ({"id": "1", "c#40": "y", "n": "five"}, [])
    assert got[3] == ({"id": "1", "c#40": "old", "a": "true"}, [])
    assert got[4] == ({"id": "1", "c#40": "z"}, [])
    assert got[5] == ({"id": "1", "c": "false", "zz": "1"}, ["a"])
    assert got[6] == ({}, []) and got[7] == ({"id": "1"}, [])


def test_cast_text(spark):
    cases = [("5", "int4", "5"), ("5.0", "int8", "5"), ("5.5", "int8", None), ("x", "int2", None), ("t", "bool", "true"), ("3.10", "numeric", "3.10"), ("x", "float8", None), ("2024-01-02", "date", "2024-01-02"), ("soon", "date", None), ("soon", "timestamptz", None), ("any", "text", "any"), ("any", "odd", "any")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, t string, e string")
    assert [(r["v"], r["t"], r["g"]) for r in df.select("*", cast_text(df["v"], df["t"]).alias("g")).orderBy("i").collect()] == cases

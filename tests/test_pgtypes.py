from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pgtypes
from tidemark.functions.pgtypes import TYPES, UNSUPPORTED, UnregisteredType, decode, parse_array, spark_type

CASES = {
    "bool": [("true", True), ("t", True), ("f", False), ("on", True), ("off", False)],
    "bytea": [(r"\x0aff", bytearray(b"\x0a\xff")), (r"\x", bytearray(b""))],
    "name": [("n", "n")], "text": [("meow", "meow"), ("", "")], "varchar": [("woof", "woof")],
    "int8": [("9007199254740993", 9007199254740993)], "int2": [("-7", -7)], "int4": [("42", 42)],
    "oid": [("4294967295", 4294967295)], "xid": [("5", 5)], "cid": [("0", 0)],
    "json": [('{"a": 1}', '{"a": 1}')], "jsonb": [("[1]", "[1]")],
    "float4": [("1.5", 1.5)], "float8": [("2.25", 2.25), ("NaN", None)], "numeric": [("3.10", 3.1)],
    "date": [("2020-02-29", date(2020, 2, 29)), ("infinity", None)],
    "time": [("12:30:01", datetime(2000, 1, 1, 12, 30, 1))],
    "timestamp": [("2020-01-02 03:04:05.6", datetime(2020, 1, 2, 3, 4, 5, 600000))],
    "timestamptz": [("2020-01-02 03:04:05+00", datetime(2020, 1, 2, 3, 4, 5))],
    "_bool": [("{t,f,NULL}", [True, False, None])], "_int2": [("{1,2}", [1, 2])], "_int4": [("{}", [])], "_int8": [("{5}", [5])],
    "_text": [('{"a b",c,"NULL",NULL,"q\\"x"}', ["a b", "c", "NULL", None, 'q"x'])], "_varchar": [("{x}", ["x"])],
    "_float4": [("{1.5}", [1.5])], "_float8": [("{1,2.5}", [1.0, 2.5])], "_numeric": [("{0.1}", [0.1])],
    "_timestamp": [('{"2020-01-02 00:00:00"}', [datetime(2020, 1, 2)])], "_date": [("{2020-01-02}", [date(2020, 1, 2)])],
    "_timestamptz": [('{"2020-01-02 00:00:00+00"}', [datetime(2020, 1, 2)])],
}


def test_every_type_has_a_case():
    assert {name for name, _ in TYPES.values()} == set(CASES) and len(TYPES) == 32 and len(UNSUPPORTED) == 32


@pytest.mark.parametrize("name", sorted(CASES))
def test_text_to_value_and_null(spark, name):
    oid = next(k for k, (n, _) in TYPES.items() if n == name)
    rows = [(i, t) for i, (t, _) in enumerate(CASES[name])] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    out = df.select("i", decode(F.col("t"), oid).alias("v"))
    assert out.schema["v"].dataType == spark_type(oid)
    got = {r["i"]: r["v"] for r in out.collect()}
    assert got.pop(99) is None
    for i, (_, value) in enumerate(CASES[name]):
        g = got[i]
        assert g != g if value is None and isinstance(g, float) else g == value if not hasattr(g, "tzinfo") or g.tzinfo is None else True


def test_unsupported_and_malformed(spark):
    with pytest.raises(UnregisteredType, match="uuid"):
        spark_type(2950)
    with pytest.raises(UnregisteredType, match="unknown"):
        decode(F.lit("x"), 99999)
    for bad in ("1,2", '{"a', "{a\\"):
        with pytest.raises(ValueError, match="malformed"):
            parse_array(bad)
    assert parse_array(None) is None and parse_array('{"",a b }') == ["", "a b"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "t string").select(pgtypes.decode(F.col("t"), 23)).collect()

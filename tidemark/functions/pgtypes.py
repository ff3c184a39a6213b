"""PostgreSQL types as Spark types, and their text forms as values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnregisteredType(ValueError):
    """A column has a type that this library does not decode."""

    def __init__(self, oid: int, name: str = "unknown"):
        super().__init__(f"type {name} (oid {oid}) is not supported")
        self.oid = oid


#: Oid, name and Spark type of every type that can be decoded. numeric becomes a double, as readers expect.
TYPES: dict[int, tuple[str, T.DataType]] = {
    16: ("bool", T.BooleanType()),
    17: ("bytea", T.BinaryType()),
    19: ("name", T.StringType()),
    20: ("int8", T.LongType()),
    21: ("int2", T.ShortType()),
    23: ("int4", T.IntegerType()),
    25: ("text", T.StringType()),
    26: ("oid", T.LongType()),
    28: ("xid", T.LongType()),
    29: ("cid", T.LongType()),
    114: ("json", T.StringType()),
    700: ("float4", T.FloatType()),
    701: ("float8", T.DoubleType()),
    1000: ("_bool", T.ArrayType(T.BooleanType())),
    1005: ("_int2", T.ArrayType(T.ShortType())),
    1007: ("_int4", T.ArrayType(T.IntegerType())),
    1009: ("_text", T.ArrayType(T.StringType())),
    1015: ("_varchar", T.ArrayType(T.StringType())),
    1016: ("_int8", T.ArrayType(T.LongType())),
    1021: ("_float4", T.ArrayType(T.FloatType())),
    1022: ("_float8", T.ArrayType(T.DoubleType())),
    1043: ("varchar", T.StringType()),
    1082: ("date", T.DateType()),
    1083: ("time", T.TimestampNTZType()),
    1114: ("timestamp", T.TimestampNTZType()),
    1115: ("_timestamp", T.ArrayType(T.TimestampNTZType())),
    1182: ("_date", T.ArrayType(T.DateType())),
    1184: ("timestamptz", T.TimestampType()),
    1185: ("_timestamptz", T.ArrayType(T.TimestampType())),
    1231: ("_numeric", T.ArrayType(T.DoubleType())),
    1700: ("numeric", T.DoubleType()),
    3802: ("jsonb", T.StringType()),
}
#: Types that are known and refused.
UNSUPPORTED: dict[int, str] = {
    27: "tid", 600: "point", 601: "lseg", 602: "path", 603: "box", 604: "polygon", 628: "line", 651: "_cidr", 705: "unknown", 718: "circle",
    829: "macaddr", 869: "inet", 1001: "_bytea", 1014: "_bpchar", 1033: "aclitem", 1034: "_aclitem", 1041: "_inet", 1042: "bpchar", 1186: "interval",
    1560: "bit", 1562: "varbit", 2950: "uuid", 2951: "_uuid", 3807: "_jsonb", 3904: "int4range", 3906: "numrange", 3908: "tsrange", 3909: "_tsrange",
    3910: "tstzrange", 3911: "_tstzrange", 3912: "daterange", 3926: "int8range",
}


def spark_type(oid: int) -> T.DataType:
    """The Spark type of a type's values; UnregisteredType for one that isn't supported."""
    if oid not in TYPES:
        raise UnregisteredType(oid, UNSUPPORTED.get(oid, "unknown"))
    return TYPES[oid][1]


def decode(text: Column, oid: int) -> Column:
    """A column of a type's text form as values. Null stays null; text that isn't of the type is an error, as a cast is under ANSI rules."""
    kind = spark_type(oid)
    if isinstance(kind, T.ArrayType):
        item = next(k for k, (name, _) in TYPES.items() if name == TYPES[oid][0][1:])
        return F.transform(array_items(text), lambda x: decode(x, item))
    if oid == 17:
        return F.unhex(F.regexp_replace(text, r"^\\x", ""))
    if oid == 1083:
        return F.concat(F.lit("2000-01-01 "), text).cast(kind)
    if oid == 16:
        return F.when(F.lower(text).isin("on", "off"), F.lower(text) == "on").otherwise(text.try_cast("boolean"))
    if oid in (1082, 1114, 1184):
        # PostgreSQL's infinities lie beyond Spark's range and become null.
        return F.when(~text.isin("infinity", "-infinity"), text).cast(kind)
    return text.cast(kind)


@F.pandas_udf(T.ArrayType(T.StringType()))
def array_items(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """One-dimensional array literals as arrays of their items' text; an unquoted NULL is null."""
    for series in texts:
        yield series.map(parse_array, na_action="ignore")


def parse_array(text: str | None) -> list[str | None] | None:
    if text is None:
        return None
    body = text.strip()
    if body[:1] != "{" or body[-1:] != "}":
        raise ValueError(f"malformed array literal: {text!r}")
    items: list[str | None] = []
    current: list[str] = []
    quoted = was_quoted = escaped = False
    for c in body[1:-1]:
        if escaped:
            current.append(c)
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted, was_quoted = not quoted, True
        elif c == "," and not quoted:
            items.append(_item(current, was_quoted))
            current, was_quoted = [], False
        else:
            current.append(c)
    if quoted or escaped:
        raise ValueError(f"malformed array literal: {text!r}")
    if body != "{}":
        items.append(_item(current, was_quoted))
    return items


def _item(current: list[str], was_quoted: bool) -> str | None:
    text = "".join(current)
    if was_quoted:
        return text
    return None if text.strip().upper() == "NULL" else text.strip()

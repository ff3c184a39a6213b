"""Row images and schema specs in JSON, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "map<string,string>"
SPEC = "struct<columns: array<struct<key: boolean, name: string, type: string, modifier: string>>>"

#: PostgreSQL's object ids of the types that occur, with their names.
OID_NAMES = {
    16: "bool",
    20: "int8",
    21: "int2",
    23: "int4",
    25: "text",
    701: "float8",
    1043: "varchar",
    1082: "date",
    1184: "timestamptz",
    1700: "numeric",
}


def image(json: Column) -> Column:
    """JSON object → map of column to value text; null for an absent image (null, ``null``, or no object)."""
    return F.from_json(json, IMAGE)


def entries(image_map: Column) -> Column:
    """The map without null values as an array of (key, value) in key order: equal images have equal arrays."""
    return F.array_sort(F.filter(F.map_entries(image_map), lambda e: e["value"].isNotNull()))


def entries_json(pairs: Column) -> Column:
    """Such an array as the text of a JSON object, keys in order, all values as strings."""
    return F.to_json(F.map_from_entries(pairs))


def type_name(type_text: Column) -> Column:
    """OID or name of a type → its name; an unknown one stays as it is."""
    plain = F.lower(F.trim(type_text))
    names = F.create_map(*[F.lit(str(x)) for pair in OID_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)


def spec_columns(spec: Column) -> Column:
    """Spec JSON → array of (name, type, key) in column order: types by name, modifiers left out, omitted members filled in."""
    listed = F.coalesce(F.from_json(spec, SPEC)["columns"], F.array().cast("array<struct<key: boolean, name: string, type: string, modifier: string>>"))
    return F.transform(
        F.filter(listed, lambda c: c["name"].isNotNull()),
        lambda c: F.struct(c["name"].alias("name"), type_name(c["type"]).alias("type"), F.coalesce(c["key"], F.lit(False)).alias("key")),
    )

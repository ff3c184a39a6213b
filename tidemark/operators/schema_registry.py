"""Versions of source tables' schemas, the steps between them, and row images brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import entries, image, spec_columns
from ..functions.storage import attach, stored
from .row_events import TABLE, micros
from .segments import carried, segmented

LAST = 1 << 62


def fingerprint(columns: Column) -> Column:
    """128 bits over names, types and keys of the columns in order. Modifiers do not count: producers disagree on them."""
    return F.md5(F.to_json(columns))


class SchemaRegistry:
    """Schema entries of a log (those with an lsn) as versions by fingerprint, with the migration step from each to the next.

    Entries of a table are ordered by lsn, then timestamp and entry_id; one whose fingerprint is that before it brings no
    version. A table with many entries is compared in stretches, each beginning with the entry carried over from the one
    before. Unreadable specs count as having no columns. ``path`` keeps the tables in between.
    """

    def __init__(self, schema_entries: DataFrame, path: str):
        self.path = path.rstrip("/")
        columns = spec_columns(F.col("spec"))
        parsed = schema_entries.where("lsn is not null").select(*TABLE, "lsn", "timestamp", "entry_id", columns.alias("columns")).withColumn("print", fingerprint(F.col("columns")))
        copies = parsed.groupBy(*TABLE, "lsn", "print").agg(F.min("timestamp").alias("timestamp"), F.min("entry_id").alias("entry_id"), F.first("columns").alias("columns"))
        order = ["lsn", "timestamp", "entry_id"]
        rows, large = segmented(stored(copies, f"{self.path}/entries"), TABLE, "lsn")
        rows = rows.withColumn("is_carried", F.lit(False))
        if large:
            before = carried(rows, TABLE, order, [*order, "print", "columns"])
            rows = rows.unionByName(before.withColumn("is_carried", F.lit(True)))
        by_table = Window.partitionBy(*TABLE, "segment").orderBy(*order)
        compared = rows.select("*", F.lag("print").over(by_table).alias("print_before"), F.lag("columns").over(by_table).alias("columns_before"))
        new = compared.where("not is_carried and (print_before is null or print <> print_before)")
        self.versions = stored(new.select(*TABLE, "lsn", "timestamp", "print", "columns", "columns_before"), f"{self.path}/versions")

    def steps(self) -> DataFrame:
        """(namespace, name, lsn, timestamp, column_name, change, old_name, old_type, new_type): each column change of each version.

        ``renamed``: a name is gone and a new name stands at its place with its type. Otherwise ``added``, ``removed``, ``retyped``.
        """
        now, was = F.col("columns"), F.col("columns_before")
        names, names_before = F.transform(now, lambda c: c["name"]), F.transform(was, lambda c: c["name"])

        def step(name: Column, change: str, old_name: Column, old_type: Column, new_type: Column) -> Column:
            return F.struct(name.alias("column_name"), F.lit(change).alias("change"), old_name.cast("string").alias("old_name"), old_type.cast("string").alias("old_type"), new_type.cast("string").alias("new_type"))

        def is_renamed(c: Column, i: Column) -> Column:
            old = F.get(was, i)
            return ~F.array_contains(names_before, c["name"]) & old.isNotNull() & ~F.array_contains(names, old["name"]) & old["type"].eqNullSafe(c["type"])

        none = F.lit(None).cast("string")
        indexed = F.transform(now, lambda c, i: F.struct(c["name"].alias("name"), c["type"].alias("type"), i.alias("at"), is_renamed(c, i).alias("renamed"), F.get(F.filter(was, lambda o: o["name"] == c["name"]), F.lit(0))["type"].alias("type_before")))
        prepared = self.versions.where("columns_before is not null").withColumn("now", indexed).withColumn("names", names).withColumn("names_before", names_before)
        renamed_at = F.transform(F.filter("now", lambda c: c["renamed"]), lambda c: c["at"])
        steps = F.concat(
            F.transform(F.filter("now", lambda c: c["renamed"]), lambda c: step(c["name"], "renamed", F.get(was, c["at"])["name"], c["type"], c["type"])),
            F.transform(F.filter("now", lambda c: ~c["renamed"] & ~F.array_contains("names_before", c["name"])), lambda c: step(c["name"], "added", none, none, c["type"])),
            F.transform(
                F.filter("now", lambda c: F.array_contains("names_before", c["name"]) & ~c["type_before"].eqNullSafe(c["type"])),
                lambda c: step(c["name"], "retyped", c["name"], c["type_before"], c["type"]),
            ),
            F.transform(
                F.filter(F.transform(was, lambda c, i: F.struct(c["name"].alias("name"), c["type"].alias("type"), i.alias("at"))), lambda c: ~F.array_contains("names", c["name"]) & ~F.array_contains("renamed_at", c["at"])),
                lambda c: step(c["name"], "removed", c["name"], c["type"], none),
            ),
        )
        return prepared.withColumn("renamed_at", renamed_at).select(*TABLE, "lsn", "timestamp", F.explode(steps).alias("step")).select(*TABLE, "lsn", "timestamp", "step.*")

    def lineages(self) -> DataFrame:
        """(namespace, name, column, since, until, since_us, until_us, final, type): what a column name stands for while it exists.

        ``final`` is the name that the column has in the end, through all renames, and ``type`` its type then. A column
        removed keeps its last name; if another column of its table ends with that name, the lsn of the removal is put to it.
        """
        steps = stored(self.steps(), f"{self.path}/steps")
        first = self.versions.where("columns_before is null").select(*TABLE, "lsn", "timestamp", F.explode("columns").alias("c"))
        fresh = first.select(*TABLE, "lsn", "timestamp", F.col("c.name").alias("column"))
        begun = fresh.unionByName(steps.where("change in ('added', 'renamed')").select(*TABLE, "lsn", "timestamp", F.col("column_name").alias("column")))
        gone = steps.where("change in ('removed', 'renamed')").select(*TABLE, "lsn", "timestamp", F.col("old_name").alias("column"), F.when(F.col("change") == "renamed", F.col("column_name")).alias("next"))
        marks = begun.withColumn("begins", F.lit(1)).unionByName(gone.withColumn("begins", F.lit(0)), allowMissingColumns=True)
        by_column = Window.partitionBy(*TABLE, "column").orderBy("lsn", "begins")
        spans = (
            marks.select("*", F.lead("lsn").over(by_column).alias("until"), F.lead("timestamp").over(by_column).alias("until_time"), F.lead("next").over(by_column).alias("next_name"))
            .where("begins = 1")
            .select(*TABLE, "column", F.col("lsn").alias("since"), F.coalesce("until", F.lit(LAST)).alias("until"), micros(F.col("timestamp")).alias("since_us"), F.coalesce(micros(F.col("until_time")), F.lit(LAST)).alias("until_us"), "next_name")
        )
        # Each round doubles the length of the chains of renames that are followed.
        links = stored(spans.select("*", F.col("column").alias("final"), F.col("until").alias("end"), F.col("next_name").alias("pending")), f"{self.path}/links0")
        for k in range(1, 63):
            if links.where("pending is not null").isEmpty():
                break
            ahead = links.select(*TABLE, F.col("column").alias("pending"), F.col("since").alias("end"), F.col("final").alias("f"), F.col("end").alias("e"), F.col("pending").alias("p"))
            joined = links.join(ahead, [*TABLE, "pending", "end"], "left")
            links = stored(
                joined.select(
                    *TABLE, "column", "since", "until", "since_us", "until_us", F.when(F.col("pending").isNull(), F.col("final")).otherwise(F.coalesce("f", "pending")).alias("final"),
                    F.coalesce("e", "end").alias("end"), F.col("p").alias("pending"),
                ),
                f"{self.path}/links{k}",
            )
        typed = self.versions.select(*TABLE, "lsn", F.explode("columns").alias("c")).select(*TABLE, "lsn", F.col("c.name").alias("final"), F.col("c.type").alias("type"))
        ends = links.join(typed, [*TABLE, "final"], "left").where("lsn is null or lsn < end").groupBy(*TABLE, "column", "since", "until", "since_us", "until_us", "final", "end").agg(F.max_by("type", "lsn").alias("type"))
        others = F.size(F.collect_set("end").over(Window.partitionBy(*TABLE, "final"))) > 1
        distinct = F.when(others & (F.col("end") < LAST), F.concat_ws("#", "final", "end")).otherwise(F.col("final"))
        return ends.select(*TABLE, "column", "since", "until", "since_us", "until_us", distinct.alias("final"), "type")

    def unify(self, modifications: DataFrame, spread: list[str]) -> DataFrame:
        """Modifications with ``attributes``, the row image (after, else before) by final name and type, and ``misfits``.

        ``attributes`` is an array of (key, value text) in key order, without nulls; a column that a version lacks is null by
        default. A value that its final type cannot hold is left out and its column named in ``misfits``. Changes are routed
        by lsn, imported rows by timestamp, a name that stands for nothing at that place by the last column so named, and
        one that never stood in a schema entry keeps its name, as text. Columns of the input named ``attributes``, ``misfits``,
        ``rules`` or ``placed`` are replaced.
        """
        modifications = modifications.drop("attributes", "misfits", "rules", "placed")
        rule = F.struct("since", "until", "since_us", "until_us", "final", "type")
        by_column = self.lineages().groupBy(*TABLE, "column").agg(F.sort_array(F.collect_list(rule)).alias("rules"))  # as often as a name came and went
        routes = by_column.groupBy(*TABLE).agg(F.map_from_entries(F.collect_list(F.struct("column", "rules"))).alias("rules"))  # PostgreSQL has at most 1600 columns a table
        routed = attach(modifications, routes, f"{self.path}/routes", TABLE, spread)
        pairs = F.coalesce(entries(image(F.col("after"))), entries(image(F.col("before"))), F.array().cast("array<struct<key: string, value: string>>"))

        def place(pair: Column) -> Column:
            named = F.try_element_at("rules", pair["key"])
            there = F.filter(
                named,
                lambda r: F.when(F.col("lsn").isNotNull(), (r["since"] <= F.col("lsn")) & (F.col("lsn") < r["until"])).otherwise((r["since_us"] <= micros(F.col("timestamp"))) & (micros(F.col("timestamp")) < r["until_us"])),
            )
            rule = F.coalesce(F.get(there, F.lit(0)), F.try_element_at(named, F.lit(-1)))
            return F.struct(F.coalesce(rule["final"], pair["key"]).alias("key"), pair["value"].alias("value"), F.coalesce(rule["type"], F.lit("text")).alias("type"))

        placed = routed.withColumn("placed", F.transform(pairs, place)).withColumn("placed", F.transform("placed", lambda p: F.struct(p["key"].alias("key"), cast_text(p["value"], p["type"]).alias("value"))))
        return placed.select(
            *modifications.columns,
            F.array_sort(F.filter("placed", lambda p: p["value"].isNotNull())).alias("attributes"),
            F.transform(F.filter("placed", lambda p: p["value"].isNull()), lambda p: p["key"]).alias("misfits"),
        )


def cast_text(value: Column, kind: Column) -> Column:
    """Value text as a value of that type, as text again; null if it is none."""

    def as_(sql: str) -> Column:
        return value.try_cast(sql).cast("string")

    whole = value.try_cast("decimal(38,0)")
    return (
        F.when(kind.isin("int2", "int4", "int8"), F.when(value.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), whole.cast("string")))
        .when(kind == "bool", as_("boolean"))
        .when(kind == "date", as_("date"))
        .when((kind == "timestamptz") & value.try_cast("timestamp").isNull(), F.lit(None))
        .when((kind.isin("numeric", "float8")) & value.try_cast("double").isNull(), F.lit(None))
        .otherwise(value)
    )

"""Raw changelog tables, one per source table, with a view of their latest rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changelog import operation
from ..functions.images import OID_NAMES
from ..functions.pgtypes import TYPES, decode
from ..functions.storage import Storage
from ..operators.changelog import confirmed, latest

NAMES = {name: oid for oid, (name, _) in TYPES.items()} | {v: k for k, v in OID_NAMES.items()}


@dataclass(frozen=True)
class TableSchema:
    """A source table's schema: (name, oid, is key) by column order, and the log position since which it holds."""

    namespace: str
    name: str
    columns: tuple[tuple[str, int, bool], ...]
    since: int = field(default=-1, compare=False)

    @classmethod
    def of(cls, namespace: str, name: str, spec: str, since: int = -1) -> TableSchema:
        def oid(kind) -> int:
            return int(kind) if str(kind).isdigit() else NAMES[str(kind)]

        return cls(namespace, name, tuple((c["name"], oid(c["type"]), bool(c.get("key"))) for c in json.loads(spec)["columns"]), since)

    @property
    def key(self) -> list[str]:
        return [name for name, _, is_key in self.columns if is_key]

    @property
    def reference(self) -> str:
        return ".".join(x.replace("%", "%25").replace(".", "%2E") for x in (self.namespace, self.name))

    def payload(self, image: Column) -> Column:
        """The typed payload of an image of texts, its fields by name."""
        return F.struct(*[decode(F.try_element_at(image, F.lit(name)), oid).alias(name) for name, oid, _ in sorted(self.columns)])


def reference() -> Column:
    """The same of the columns namespace and name. Dots within either are escaped, so two tables never share one."""
    return F.concat_ws(".", *[F.replace(F.replace(F.col(c), F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E")) for c in ("namespace", "name")])


@dataclass
class RawTables:
    """Appends modifications to raw tables under ``path``, registers and widens them by schema, and serves their latest rows.

    A table is known by namespace and name, so equal names and equal columns in two namespaces stay apart. Each schema
    seen is a version kept with the table; columns are added, never dropped, and a column whose type changed is
    kept under its name with the type's name, so files stay readable. Micro-batches are written under their number: a
    batch that is repeated replaces its files.
    """

    spark: SparkSession
    path: str
    schemas: dict[str, list[TableSchema]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.path, self.fs = self.path.rstrip("/"), Storage(self.spark)
        for ref in self.fs.names(f"{self.path}/schemas"):
            for number in self.fs.names(f"{self.path}/schemas/{ref}"):
                if number.endswith(".json"):
                    x = self.fs.load(f"{self.path}/schemas/{ref}/{number}")
                    self.schemas.setdefault(ref, []).append(TableSchema(x["namespace"], x["name"], tuple((n, o, k) for n, o, k in x["columns"]), x["since"]))

    def register(self, schema: TableSchema) -> str:
        """``noop`` if the table's newest schema is this one, or one from as late in the log is known; otherwise ``update``."""
        seen = self.schemas.setdefault(schema.reference, [])
        if seen and (seen[-1] == schema or -1 < schema.since <= seen[-1].since):
            return "noop"
        self.fs.create(f"{self.path}/schemas/{schema.reference}/{len(seen):06d}.json", {"namespace": schema.namespace, "name": schema.name, "columns": [list(c) for c in schema.columns], "since": schema.since})
        seen.append(schema)
        return "update"

    def append(self, ref: str, rows: DataFrame, batch: int, part: int = 0, before: int | None = None) -> None:
        """Append modifications of one table under its newest schema, or the newest ``before`` a log position, by day and sorted by key."""
        schema = [s for s in self.schemas[ref] if before is None or s.since < before][-1]
        payload = schema.payload(F.coalesce("after", "before"))
        what = operation(F.col("lsn"), F.col("before"), F.col("after"), F.col("message_type") if "message_type" in rows.columns else None)
        raw = rows.select("timestamp", "lsn", "sequence", what.alias("operation"), payload.alias("payload"), F.to_date("timestamp").alias("date"))
        key = [F.col("payload")[k] for k in schema.key]
        raw.sortWithinPartitions("date", *key).write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/raw/{ref}/batch={batch}-{part}")

    def raw(self, ref: str) -> DataFrame:
        """All rows of a raw table, with every payload field that any of its versions has."""
        merged: dict[str, T.DataType] = {}
        for schema in self.schemas[ref]:
            for name, oid, _ in sorted(schema.columns):
                merged.setdefault(name, TYPES[oid][1])
        fields = T.StructType([T.StructField(n, merged[n]) for n in sorted(merged)])
        layout = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("lsn", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("operation", T.StringType()), T.StructField("payload", fields)])
        folders = [f"{self.path}/raw/{ref}/{x}" for x in self.fs.names(f"{self.path}/raw/{ref}") if x.startswith("batch=")]
        if not folders:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(T.StructType([*layout.fields, T.StructField("date", T.DateType())])).option("basePath", f"{self.path}/raw/{ref}").parquet(*folders).drop("batch")

    def latest(self, ref: str) -> DataFrame:
        """The present rows of a source table: the last of each key by time, log position and sequence, unless it was deleted."""
        key = [f"_k{i}" for i, _ in enumerate(self.schemas[ref][-1].key)]
        rows = self.raw(ref)
        keyed = rows.select("*", *[F.col("payload")[k].alias(alias) for k, alias in zip(self.schemas[ref][-1].key, key)])
        return latest(keyed, key, ["timestamp", "lsn", "sequence"], F.col("operation") != "DELETE").select("payload.*")

    def create_views(self) -> list[str]:
        """Temporary views of the latest rows, named namespace_table; where that would name two tables, with the length of the namespace after it, which tells them apart."""
        plain = {ref: f"{s[-1].namespace}_{s[-1].name}" for ref, s in self.schemas.items()}
        names = []
        for ref in sorted(plain):
            name = plain[ref] if list(plain.values()).count(plain[ref]) == 1 else f"{plain[ref]}_{len(self.schemas[ref][-1].namespace)}"
            self.latest(ref).createOrReplaceTempView(f"`{name}`")
            names.append(name)
        return names


@dataclass
class BatchSink:
    """The function for ``foreachBatch`` that routes a changelog's entries to tables.

    A micro-batch is written once, by table, and each table then reads its own part. Within it a table's modifications before and after each
    of its schema entries are written under the schema that held for them. ``ack`` is told the highest position of a whole
    transaction once all of the batch is written.
    """

    tables: RawTables
    ack: Callable[[int], None] | None = None

    def __call__(self, entries: DataFrame, batch: int) -> None:
        spark = entries.sparkSession
        at = f"{self.tables.path}/incoming/batch={batch}"
        entries.withColumn("_ref", reference()).write.mode("overwrite").partitionBy("kind", "_ref").parquet(at)
        rows = spark.read.schema(T.StructType([*entries.schema.fields, T.StructField("_ref", T.StringType())])).parquet(at)
        # Tables and schema entries of one micro-batch: control data, bounded by the batch's size option.
        marks: dict[str, list[TableSchema]] = {}
        for r in rows.where("kind = 'schema'").orderBy("position").select("namespace", "name", "position", "spec").toLocalIterator():
            schema = TableSchema.of(r["namespace"], r["name"], r["spec"], r["position"])
            marks.setdefault(schema.reference, []).append(schema)
        refs = {r[0] for r in rows.where("kind = 'modification'").select("_ref").distinct().toLocalIterator()}
        for ref in sorted({*refs, *marks}):
            own = rows.where((F.col("kind") == "modification") & (F.col("_ref") == ref)).drop("_ref")
            low = None
            for part, schema in enumerate([*marks.get(ref, []), None]):
                span = own if low is None else own.where(F.col("position") > low)
                position = schema.since if schema else None
                span = span if position is None else span.where(F.col("position") < position)
                if ref in refs and (ref not in marks or not span.isEmpty()):
                    if not any(position is None or s.since < position for s in self.tables.schemas.get(ref, [])):
                        raise ValueError(f"modifications of {ref} came before any schema of it")
                    self.tables.append(ref, span, batch, part, position)
                if schema is not None:
                    self.tables.register(schema)
                    low = position
        if self.ack:
            top = confirmed(rows).first()[0]
            if top is not None:
                self.ack(top)
        self.tables.fs.delete(at)

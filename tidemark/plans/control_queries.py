"""Queries of the changelog, import, control and metric operators over the star-schema tables.

``events`` stands for the log of a table keyed by user (lsn = event_id, five events a transaction), ``orders`` for a table to
be imported, ``orders`` and ``lineitem`` for tables and their jobs, ``nation`` and ``region`` for catalog tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import changelog as fn
from ..functions import pgtypes
from ..functions.images import image, spec_columns
from ..functions.storage import stored, workspace
from ..operators import changelog, control, imports, metrics, numbering
from ..sinks import files
from ..sinks.raw_tables import BatchSink, RawTables
from ..sources import catalog, pgoutput
from ..streaming.changelog_stream import changelog_stream, write_entries
from .tables import stream, table


def _lsn_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def latest_view(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return changelog.latest(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_type", "value")


def latest_view_composite(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(s, d, "events").select("user_id", k.alias("k"), "event_id", "ts", "event_type", "value")
    return changelog.latest(rows, ["user_id", "k"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "k", "event_type", "value")


def latest_as_of(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").where("ts <= timestamp_ntz '2024-01-15 00:00:00'").select("user_id", "event_id", "ts", "event_type", "value")
    return changelog.latest(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_type", "value")


def raw_changelog(s: SparkSession, d: str) -> DataFrame:
    sent = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    row = F.struct("user_id", "event_type", "value")
    rows = table(s, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_id").alias("lsn"), F.lit(1).alias("sequence"), sent.alias("message_type"), F.when(sent == "D", row).alias("before"), F.when(sent != "D", row).alias("after"))
    return changelog.raw_changelog(rows, fn.after_or_before(F.col("before"), F.col("after"))).select("timestamp", "lsn", "operation", "payload.*")


def operation_infer(s: SparkSession, d: str) -> DataFrame:
    events = _lsn_time(table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    log = changelog.with_previous(events.drop("ts"), ["user_id"], ["at", "event_id"], {"b": "value"})
    streamed = log.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("id"), "b", F.when(F.col("event_type") != "error", F.col("value")).alias("a"))
    none = F.lit(None)
    imported = table(s, d, "customer").select(none.cast("bigint").alias("lsn"), F.col("c_custkey").alias("id"), none.cast("double").alias("b"), F.col("c_acctbal").alias("a"))
    both = changelog.merged(streamed, imported)
    return both.select("id", "lsn", fn.operation(F.col("lsn"), F.col("b"), F.col("a")).alias("operation"), fn.after_or_before(F.col("b"), F.col("a")).alias("value"))


def _messages(rows: DataFrame) -> DataFrame:
    """Events as decoded messages (slot, position, message): each transaction with its begin and commit, its last position in both."""
    xid = F.floor(F.col("event_id") / 5).cast("bigint")
    of = Window.partitionBy("xid")
    known = rows.select("event_id", xid.alias("xid")).select("*", F.min("event_id").over(of).alias("first"), F.max("event_id").over(of).alias("last"))

    def message(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("msg_type"), F.col("last").alias("lsn"), F.col("xid").alias("timestamp_us"), F.col("xid"))

    made = F.array(
        F.when(F.col("event_id") == F.col("first"), F.struct((F.col("event_id") * 10).alias("position"), message("B").alias("message"))),
        F.struct((F.col("event_id") * 10 + 5).alias("position"), message("I").alias("message")),
        F.when(F.col("event_id") == F.col("last"), F.struct((F.col("event_id") * 10 + 9).alias("position"), message("C").alias("message"))),
    )
    return known.select((F.col("xid") % 8).cast("string").alias("slot"), F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m")).select("slot", "m.*")


def sequence_messages(s: SparkSession, d: str) -> DataFrame:
    found = changelog.sequenced(stored(_messages(table(s, d, "events")), f"{workspace(s, 'messages')}/messages"))
    return found.select(F.floor(F.col("position") / 10).cast("bigint").alias("event_id"), "xid", "sequence", "begin_lsn")


def flush_fold(s: SparkSession, d: str) -> DataFrame:
    batch = F.floor(F.col("event_id") / 250).cast("bigint")
    rows = table(s, d, "events").select(batch.alias("batch"), F.col("event_id").alias("lsn"))
    return changelog.batch_result(rows, ["batch"]).select("batch", F.col("count").alias("n"), "lsn")


def import_page(s: SparkSession, d: str) -> DataFrame:
    return imports.page(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 4999, 5000)


def import_batches(s: SparkSession, d: str) -> DataFrame:
    keys = numbering.numbered(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "n", workspace(s, "pages"))
    page = F.floor(F.col("n") / 4000).cast("bigint")
    return keys.groupBy(page.alias("page")).agg(F.count("*").alias("n"), F.max("o_orderkey").cast("string").alias("cursor"), (F.count("*") < 4000).alias("complete"))


def _names(rows: DataFrame, column: str, *more: str) -> DataFrame:
    """Rows as tables of one schema, named by a column."""
    return rows.select(F.lit("public").alias("schema"), F.col(column).cast("string").alias("table_name"), *more)


def tables_diff(s: SparkSession, d: str) -> DataFrame:
    lacking = control.difference(_names(table(s, d, "orders"), "o_orderkey"), _names(table(s, d, "lineitem"), "l_orderkey"))
    return lacking.select(F.col("table_name").cast("bigint").alias("o_orderkey"))


def tables_includes(s: SparkSession, d: str) -> DataFrame:
    held = _names(table(s, d, "orders").where("o_orderstatus = 'P'"), "o_custkey")
    found = control.included(_names(table(s, d, "customer"), "c_custkey", "c_name"), held)
    return found.select(F.col("table_name").cast("bigint").alias("c_custkey"), "c_name")


def catalog_join(s: SparkSession, d: str) -> DataFrame:
    """Relations of the chosen schemas: nations are relations, regions schemas."""
    chosen = table(s, d, "region").where(F.col("r_name").isin(fn.listed("ASIA,EUROPE"))).select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname"))
    classes = table(s, d, "nation").select(F.col("n_nationkey").alias("oid"), F.col("n_name").alias("relname"), F.col("n_regionkey").alias("relnamespace"))
    return catalog.relations(classes, chosen).select(F.col("namespace").alias("r_name"), F.col("name").alias("n_name"))


def key_index_join(s: SparkSession, d: str) -> DataFrame:
    """Columns that an index names by their numbers, as a catalog keeps them: nations are columns, regions relations."""
    attributes = table(s, d, "nation").select(F.col("n_regionkey").alias("attrelid"), (F.col("n_nationkey") + 1).alias("attnum"), F.col("n_name").alias("attname"), F.lit(25).alias("atttypid"), F.lit(0).alias("atttypmod"), F.lit(False).alias("attisdropped"))
    indexes = attributes.where("attnum % 2 = 0").groupBy(F.col("attrelid").alias("indrelid")).agg(F.collect_list("attnum").alias("indkey"), F.lit(True).alias("indisprimary"))
    return catalog.key_attributes(indexes, attributes)


def pk_array_agg(s: SparkSession, d: str) -> DataFrame:
    return imports.key_lists(table(s, d, "nation"), ["n_regionkey"], "n_name")


def table_status(s: SparkSession, d: str) -> DataFrame:
    """Orders as tables and their lines as imports: the newest one, found before the join so that it is of one row a table, gives the status."""
    made, at = F.col("l_shipdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")
    number = F.col("l_linenumber").cast("bigint") * (1 << 56) + F.col("l_partkey") * (1 << 24) + F.col("l_suppkey")
    lines = _names(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    jobs = lines.select(
        "schema", "table_name", F.lit("s").alias("subscription_id"), number.alias("id"), made.alias("created_at"), F.when(F.col("l_returnflag") == "R", at).alias("expired_at"),
        F.when(F.col("l_returnflag") == "A", at).alias("completed_at"), F.when(F.col("l_linestatus") == "F", "x").alias("error"), F.lit(None).cast("string").alias("cursor"),
        F.lit(0).cast("bigint").alias("rows_processed_total"),
    )
    orders = _names(table(s, d, "orders"), "o_orderkey")
    return control.table_list(orders, orders.limit(0), jobs, "s").select(F.col("table_name").cast("bigint").alias("o_orderkey"), "import_status")


def _errors() -> Column:
    return F.col("o_orderkey") % 9


def job_backoff(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", _errors().alias("error_count"), fn.retry_delay(_errors()).alias("delay_seconds"))


def job_acquire(s: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: the open ones are those not delivered."""
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    jobs = table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("s").alias("subscription_id"), F.when(F.col("o_orderstatus") != "O", at).alias("completed_at"), F.lit(None).cast("timestamp").alias("expired_at"),
        _errors().alias("error_count"), F.when(_errors() > 0, "x").alias("error"), F.col("o_orderdate").cast("timestamp").alias("last_error_at"),
    )
    job = imports.acquire(jobs, "s", at)
    return s.createDataFrame([(job["id"],)] if job else [], "o_orderkey bigint")


def schema_fingerprint(s: SparkSession, d: str) -> DataFrame:
    column = F.struct(F.col("n_nationkey").alias("place"), F.lit(False).alias("key"), F.col("n_name").alias("name"), F.lit(25).alias("type"))
    specs = table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    return table(s, d, "region").join(specs, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", fn.fingerprint(F.col("columns")).alias("fp"))


def publication_filter(s: SparkSession, d: str) -> DataFrame:
    """Parts as tables named by brand, in schemas named by size."""
    parts = table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("schema"), F.col("p_brand").alias("table_name"))
    chosen = ["1", "5", "10"]
    return control.watched(parts, chosen, excludes=[f"{x}.Brand#11" for x in chosen]).select("p_partkey", F.col("table_name").alias("p_brand"))


def publication_reconcile(s: SparkSession, d: str) -> DataFrame:
    watched = table(s, d, "customer").where("c_acctbal > 0").select(F.lit("public").alias("schema"), F.col("c_custkey").cast("string").alias("table_name"))
    published = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.lit("public").alias("schema"), F.col("o_custkey").cast("string").alias("table_name"))
    return control.reconcile(watched, published)


def route_counts(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, x).select(fn.table_reference(F.lit("public"), F.lit(x)).alias("ref")) for x in ("orders", "customer", "events")]
    return metrics.counters(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["ref"])


def metrics_rate(s: SparkSession, d: str) -> DataFrame:
    return metrics.rates(table(s, d, "events"), "ts", "hour", 3600, ["event_type"])


def metrics_histogram(s: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(s, d, "events"), "value", *metrics.QUERY_SECONDS)


def metrics_heatmap(s: SparkSession, d: str) -> DataFrame:
    return metrics.bucket_rates(table(s, d, "events"), "ts", "day", 86400, "value", *metrics.FLUSH_SECONDS)


def metrics_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Quantiles read from histograms, as a dashboard does."""
    counts = metrics.histogram(table(s, d, "events"), "value", *metrics.BATCH_SIZE, ["event_type"])
    return metrics.histogram_quantile(counts, 0.5, ["event_type"])


def toast_carry_forward(s: SparkSession, d: str) -> DataFrame:
    rows = _lsn_time(table(s, d, "events").select("event_id", "ts", "user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))).drop("ts")
    return changelog.filled(rows, ["user_id"], "at", ["value"]).select("event_id", "user_id", "value")


def progress(s: SparkSession, d: str) -> DataFrame:
    done = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("done"))
    joined = table(s, d, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", fn.progress(F.coalesce("done", F.lit(0)), F.lit(12)).alias("pct"))


def txn_visible(s: SparkSession, d: str) -> DataFrame:
    """What may be confirmed before the newest transaction, which may not be whole, has its commit."""
    xid = F.floor(F.col("event_id") / 5).cast("bigint")
    whole = table(s, d, "events").groupBy(xid.alias("xid")).agg(F.max("event_id").alias("lsn"))
    newest = F.broadcast(whole.agg(F.max("xid").alias("newest")))  # one row
    acks = whole.join(newest, F.col("xid") < F.col("newest")).select(F.lit("ack").alias("kind"), "lsn")
    return changelog.confirmed(acks).select(F.col("lsn").alias("acked_lsn"))


def lsn_text(s: SparkSession, d: str) -> DataFrame:
    text = fn.format_lsn(F.col("lsn"))
    return table(s, d, "modifications").where("lsn is not null").select("delivery_id", text.alias("lsn_text"), fn.parse_lsn(text).alias("lsn"))


def _recorded(events: DataFrame, last: Column) -> DataFrame:
    """Events as the bytes of replication streams: (slot, position, data). Every transaction has a begin and a relation message, and after its ``last`` event a commit."""
    relation = {
        "msg_type": "R", "relation_id": 1, "namespace": "public", "name": "users", "replica_identity": "d",
        "columns": [{"key": True, "name": "user_id", "type": 20, "modifier": 0}, {"key": False, "name": "value", "type": 701, "modifier": 0}],
    }

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for event, user, kind, value, is_last in zip(*(frame[c] for c in ("event_id", "user_id", "event_type", "text", "last"))):
                row = [{"type": "t", "value": str(user)}, {"type": "t", "value": value}]
                change = {"msg_type": "D", "relation_id": 1, "old_kind": "O", "old_row": row} if kind == "error" else {"msg_type": "I" if kind == "signup" else "U", "relation_id": 1, "row": row}
                event, xid = int(event), int(event) // 5
                stamp = {"lsn": xid * 5 + 4, "timestamp_us": pgoutput.EPOCH + xid}
                parts = [(5, change)]
                if event % 5 == 0:
                    parts = [(0, {"msg_type": "B", "xid": xid, **stamp}), (1, relation), *parts]
                if is_last:
                    parts.append((9, {"msg_type": "C", "transaction_lsn": xid * 5 + 4, **stamp}))
                data += [(str(xid % 8), event * 10 + at, pgoutput.encode_message(m)) for at, m in parts]
            yield pd.DataFrame(data, columns=["slot", "position", "data"])

    rows = events.select("event_id", "user_id", "event_type", F.col("value").cast("string").alias("text"), last.alias("last"))
    return rows.mapInPandas(encode, "slot string, position bigint, data binary")


def _event_rows(found: DataFrame, before: Column, after: Column) -> DataFrame:
    image = fn.after_or_before(before, after)
    what = fn.operation(F.col("lsn"), before, after, F.col("message_type"))
    return found.where("kind = 'modification'").select(
        F.floor(F.col("position") / 10).cast("bigint").alias("event_id"), fn.table_reference(F.col("namespace"), F.col("name")).alias("ref"), what.alias("operation"), "lsn", "sequence",
        image["user_id"].cast("bigint").alias("user_id"), image["value"].cast("double").alias("value"),
    )


def wal_entries(s: SparkSession, d: str) -> DataFrame:
    """Events as bytes, decoded, put in sequence and resolved as a table."""
    last = F.col("event_id") == F.max("event_id").over(Window.partitionBy(F.floor(F.col("event_id") / 5)))
    decoded = pgoutput.decode(_recorded(table(s, d, "events"), last), "data", ["slot", "position"]).select("slot", "position", "message")
    return _event_rows(changelog.entries(decoded, workspace(s, "entries")), F.col("before"), F.col("after"))


def streamed_entries(s: SparkSession, d: str) -> DataFrame:
    """The same as a stream, with the open transaction and the relations of each slot as state."""
    decoded = pgoutput.decode(_recorded(stream(s, d, "events", maxBytesPerTrigger=str(256 << 20)), F.col("event_id") % 5 == 4), "data", ["slot", "position"])
    at = workspace(s, "streamed")
    write_entries(changelog_stream(decoded.select("slot", "position", "message")), at)
    return _event_rows(s.read.parquet(f"{at}/entries"), image(F.col("before")), image(F.col("after")))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """The import jobs of the test data, in the columns that jobs have."""
    return table(s, d, "import_jobs").select(*imports.JOB.fieldNames())


def _present_tables(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "schema_entries").select(F.col("namespace").alias("schema"), F.col("name").alias("table_name")).where("schema is not null and table_name is not null").distinct()


SUBSCRIPTION = "sub_000000"
NOW = datetime(2030, 1, 1, tzinfo=timezone.utc)


def table_list(s: SparkSession, d: str) -> DataFrame:
    """All tables with their publication and import status in one subscription."""
    tables = _present_tables(s, d)
    return control.table_list(tables, tables.where("schema = 'public'"), _jobs(s, d), SUBSCRIPTION)


def newest_jobs(s: SparkSession, d: str) -> DataFrame:
    return control.newest_jobs(_jobs(s, d)).select("subscription_id", "schema", "table_name", "id", "cursor", "rows_processed_total")


def jobs_by_table(s: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform("jobs", lambda j: j["id"].cast("string")), ",")
    return control.jobs_by_table(_jobs(s, d)).select("schema", "table_name", ids.alias("ids"))


def missing_jobs(s: SparkSession, d: str) -> DataFrame:
    return imports.missing_jobs(_present_tables(s, d), _jobs(s, d), SUBSCRIPTION)


def created_jobs(s: SparkSession, d: str) -> DataFrame:
    """The jobs that tables without one get."""
    jobs = _jobs(s, d)
    made = imports.create_jobs(jobs, imports.missing_jobs(_present_tables(s, d), jobs, SUBSCRIPTION), SUBSCRIPTION, NOW)
    return made.where(F.col("created_at") == F.lit(NOW)).select("id", "subscription_id", "schema", "table_name", "cursor", "error_count", "rows_processed_total")


def _outcome(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "id", "cursor", "error", "error_count", "rows_processed_total", F.col("completed_at").isNotNull().alias("completed"), F.col("expired_at").isNotNull().alias("expired"),
        F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("last_error_at").alias("last_error_us"),
    )


def job_succeeded(s: SparkSession, d: str) -> DataFrame:
    return _outcome(imports.succeeded(_jobs(s, d), 22, imports.Outcome(17, "K17", True), NOW))


def job_failed(s: SparkSession, d: str) -> DataFrame:
    return _outcome(imports.failed(_jobs(s, d), 22, "no route", NOW))


def job_expired(s: SparkSession, d: str) -> DataFrame:
    return _outcome(imports.expired(_jobs(s, d), SUBSCRIPTION, "tenant_000000", "tickets", NOW))


def import_run(s: SparkSession, d: str) -> DataFrame:
    """A whole import by pages from a cursor kept as text: what came out, and what the pages held."""
    at = workspace(s, "import")
    job = Row(id=1, schema="public", table_name="customer", cursor="100")
    options = imports.ImportOptions(batch_limit=max(1000, (table(s, d, "customer").count() + 3) // 4))
    outcome = imports.import_table(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", job, lambda rows: rows.write.mode("append").parquet(at), options, lambda: NOW)
    landed = s.read.parquet(at).agg(F.count("*").alias("landed"), F.sum(F.get_json_object("after", "$.c_custkey").cast("bigint")).alias("keys"), F.min("name").alias("name"), F.count("lsn").alias("with_lsn"))
    return landed.select("*", F.lit(outcome.rows).cast("bigint").alias("rows"), F.lit(outcome.cursor).alias("cursor"), F.lit(outcome.complete).alias("complete"))


def imported_rows(s: SparkSession, d: str) -> DataFrame:
    """All rows after a cursor as modifications, in one read."""
    rows = imports.backfill(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", imports.typed_cursor("50", LongType()), "public", "customer", NOW)
    return rows.select(fn.table_reference(F.col("namespace"), F.col("name")).alias("ref"), F.unix_micros("timestamp").alias("read_us"), "lsn", "sequence", "before", F.get_json_object("after", "$.c_custkey").alias("c_custkey"), F.get_json_object("after", "$.c_name").alias("c_name"))


def decoded_values(s: SparkSession, d: str) -> DataFrame:
    """Values of the commonest types from their text forms."""
    text = table(s, d, "orders").select("*", F.concat(F.lit("{"), F.col("o_orderkey").cast("string"), F.lit(",NULL,"), F.col("o_custkey").cast("string"), F.lit("}")).alias("numbers"), F.concat(F.lit('{"a ,'), F.col("o_orderstatus"), F.lit('",NULL,x}')).alias("words"))
    return text.select(
        pgtypes.decode(F.col("o_orderkey").cast("string"), 20).alias("int8"), pgtypes.decode(F.col("o_totalprice").cast("string"), 1700).alias("numeric"),
        pgtypes.decode(F.date_format("o_orderdate", "yyyy-MM-dd"), 1082).alias("date"), pgtypes.decode(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), 1114).alias("timestamp"),
        pgtypes.decode(F.when(F.col("o_orderstatus") == "O", "on").otherwise("f"), 16).alias("bool"), F.hex(pgtypes.decode(F.concat(F.lit(r"\x0a"), F.lower(F.hex("o_orderkey")), F.when(F.length(F.hex("o_orderkey")) % 2 == 1, "0").otherwise("")), 17)).alias("bytea"),
        F.array_join(pgtypes.decode(F.col("numbers"), 1016), "/", "-").alias("int8s"), F.array_join(pgtypes.decode(F.col("words"), 1009), "/", "-").alias("texts"),
    )


def _user_entries(rows: DataFrame, columns: list[str], position: int) -> DataFrame:
    """Events as changelog entries of a table of users with these columns, after a schema entry at a position."""
    types = {"user_id": 20, "event_type": 25, "value": 701}
    spec = json.dumps({"columns": [{"key": c == "user_id", "name": c, "type": types[c]} for c in columns]})
    row = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    deleted = F.col("event_type") == "error"
    none = F.lit(None)
    entries = rows.select(
        F.col("event_id").alias("position"), F.lit("modification").alias("kind"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("app.v1").alias("namespace"), F.lit("users").alias("name"), F.col("event_id").alias("lsn"),
        F.lit(1).cast("bigint").alias("sequence"), F.when(deleted, "D").otherwise("U").alias("message_type"), none.cast("string").alias("spec"), F.when(deleted, row).alias("before"), F.when(~deleted, row).alias("after"),
    )
    schema = rows.sparkSession.range(1).select(
        F.lit(position).cast("bigint").alias("position"), F.lit("schema").alias("kind"), none.cast("timestamp").alias("timestamp"), F.lit("app.v1").alias("namespace"), F.lit("users").alias("name"),
        F.lit(position).cast("bigint").alias("lsn"), none.cast("bigint").alias("sequence"), F.lit("R").alias("message_type"), F.lit(spec).alias("spec"), none.cast("map<string,string>").alias("before"), none.cast("map<string,string>").alias("after"),
    )
    return entries.unionByName(schema)


def raw_tables(s: SparkSession, d: str) -> DataFrame:
    """Entries routed by table and schema into raw tables in two batches, the second of which adds a column; the latest rows through the table's view."""
    sink = BatchSink(RawTables(s, workspace(s, "raw")))
    rows = table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    sink(_user_entries(rows.where("event_id < 2000"), ["user_id", "event_type"], -1), 0)
    for _ in range(2):  # a batch that is repeated replaces its files
        sink(_user_entries(rows.where("event_id >= 2000"), ["user_id", "event_type", "value"], 1999), 1)
    (view,) = sink.tables.create_views()
    return s.table(f"`{view}`")


def routed_operations(s: SparkSession, d: str) -> DataFrame:
    """Rows of a raw table by day and operation."""
    tables = RawTables(s, workspace(s, "routed"))
    BatchSink(tables)(_user_entries(table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type", "value"], -1), 0)
    (ref,) = tables.schemas
    return tables.raw(ref).groupBy(F.col("date").cast("string").alias("day"), "operation").agg(F.count("*").alias("n"), F.max("lsn").alias("lsn"))


def json_sink(s: SparkSession, d: str) -> DataFrame:
    """Entries written as JSON and read again, and what the sink says was written."""
    at = workspace(s, "json")
    count, lsn = files.write_json(table(s, d, "events").select(F.col("event_id").alias("lsn"), "event_type", "value"), at)
    back = s.read.schema("lsn bigint, event_type string, value double").json(at)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.max("lsn").alias("top")).select("*", F.lit(count).cast("bigint").alias("written"), F.lit(lsn).cast("bigint").alias("last_lsn"))


def table_search(s: SparkSession, d: str) -> DataFrame:
    return control.search(table(s, d, "nation").select(F.lit("public").alias("schema"), F.col("n_name").alias("table_name")), "nation_12", 1).select("table_name")


def _publications(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions as publications, nations as their tables."""
    regions = table(s, d, "region").select(F.col("r_name").alias("name"))
    joined = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return regions, joined.select(F.col("r_name").alias("publication"), F.lit("public").alias("schema"), F.col("n_name").alias("table_name"))


def published_tables(s: SparkSession, d: str) -> DataFrame:
    publications, members = _publications(s, d)
    return control.published_tables(control.find_publication(publications, "ASIA"), members, "ASIA")


def publication_edit(s: SparkSession, d: str) -> DataFrame:
    publications, members = _publications(s, d)
    tables = control.published_tables(publications, members, "EUROPE")
    return control.remove_table(control.add_table(control.add_table(tables, "public", "NEW"), "public", "NATION_3"), "public", "NATION_8")


def _catalog(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classes, namespaces, attributes and indexes: nations are relations in regions' schemas, customers columns of their nation."""
    classes = table(s, d, "nation").select(F.col("n_nationkey").alias("oid"), F.col("n_name").alias("relname"), F.col("n_regionkey").alias("relnamespace"))
    namespaces = table(s, d, "region").select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname"))
    attributes = table(s, d, "customer").where("c_custkey <= 200").select(
        F.col("c_nationkey").alias("attrelid"), F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(F.col("c_custkey")).alias("attnum"), F.col("c_name").alias("attname"), F.lit(25).alias("atttypid"), F.lit(7).alias("atttypmod"), (F.col("c_custkey") % 7 == 0).alias("attisdropped"),
    )
    indexes = attributes.groupBy(F.col("attrelid").alias("indrelid")).agg(F.array(F.max("attnum")).alias("indkey"), F.lit(True).alias("indisprimary"))
    return classes, namespaces, attributes, indexes


def catalog_tables(s: SparkSession, d: str) -> DataFrame:
    classes, namespaces, _, _ = _catalog(s, d)
    kind = F.when(F.col("n_nationkey") % 3 == 0, "VIEW").otherwise("BASE TABLE")
    information = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("table_schema"), F.col("n_name").alias("table_name"), kind.alias("table_type"))
    return catalog.tables(information, classes, namespaces)


def catalog_schemas(s: SparkSession, d: str) -> DataFrame:
    columns = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.when(c["key"], "*").otherwise(""))), ",")
    return catalog.schemas(*_catalog(s, d)).select("relation_id", "namespace", "name", columns.alias("columns"))


def primary_keys(s: SparkSession, d: str) -> DataFrame:
    columns = spec_columns(F.col("spec"))
    return table(s, d, "schema_entries").select("entry_id", F.array_join(fn.primary_key(columns), ",").alias("keys"))


def base_tables(s: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("VIEW"), F.lit("MANAGED"), F.lit("TEMPORARY")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return control.base_tables(table(s, d, "nation").select(F.lit("public").alias("schema"), F.col("n_name").alias("table_name"), kinds.alias("table_type")))


def last_positions(s: SparkSession, d: str) -> DataFrame:
    return changelog.last_lsn(table(s, d, "modifications").select("delivery_id", "lsn"), "delivery_id")


def text_forms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", fn.rfc3339(F.col("ts").cast("timestamp")).alias("at"), fn.slot_name(F.col("event_type"), F.col("user_id").cast("string")).alias("slot"))


def event_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of whole numbers, exact at this accuracy."""
    return metrics.quantiles(table(s, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", [0.5, 0.9], ["l_returnflag"])


QUERIES = {
    f.__name__: f
    for f in (
        latest_view, latest_view_composite, latest_as_of, raw_changelog, operation_infer, sequence_messages, flush_fold, import_page, import_batches, tables_diff,
        tables_includes, catalog_join, key_index_join, pk_array_agg, table_status, job_backoff, job_acquire, schema_fingerprint, publication_filter, publication_reconcile, route_counts,
        metrics_rate, metrics_histogram, metrics_heatmap, metrics_quantiles, toast_carry_forward, progress, txn_visible, lsn_text, wal_entries, streamed_entries,
        table_list, newest_jobs, jobs_by_table, missing_jobs, created_jobs, job_succeeded, job_failed, job_expired, import_run, imported_rows, decoded_values, raw_tables, routed_operations, json_sink,
        table_search, published_tables, publication_edit, catalog_tables, catalog_schemas, primary_keys, base_tables, last_positions, text_forms, event_quantiles,
    )
}

SQL = {
    "latest_view": """
        select user_id, event_type, value from (
            select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
        where rn = 1 and event_type <> 'error'""",
    "latest_view_composite": """
        select user_id, k, event_type, value from (
            select *, row_number() over (partition by user_id, k order by ts desc, event_id desc) rn
            from (select *, cast(json_extract(props, '$.k') as integer) k from events))
        where rn = 1 and event_type <> 'error'""",
    "latest_as_of": """
        select user_id, event_type, value from (
            select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn
            from events where ts <= timestamp '2024-01-15 00:00:00')
        where rn = 1 and event_type <> 'error'""",
    "raw_changelog": """
        select ts as "timestamp", event_id as lsn,
            case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as operation,
            user_id, event_type, value from events""",
    "operation_infer": """
        with m as (
            select event_id as lsn, user_id as id, lag(value) over (partition by user_id order by ts, event_id) as b,
                case when event_type = 'error' then null else value end as a from events
            union all select null, c_custkey, null, c_acctbal from customer)
        select id, lsn, case when lsn is null then 'IMPORT' when b is null then 'INSERT' when a is null then 'DELETE' else 'UPDATE' end as operation,
            coalesce(a, b) as value from m""",
    "sequence_messages": """
        select event_id, event_id // 5 as xid, row_number() over (partition by event_id // 5 order by event_id) as sequence,
            max(event_id) over (partition by event_id // 5) as begin_lsn from events""",
    "flush_fold": "select event_id // 250 as batch, count(*) as n, max(event_id) as lsn from events group by 1",
    "import_page": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey > 4999 order by o_orderkey limit 5000",
    "import_batches": """
        with p as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 4000 as page from orders)
        select page, count(*) as n, cast(max(o_orderkey) as varchar) as cursor, count(*) < 4000 as complete from p group by page""",
    "tables_diff": "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "tables_includes": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "catalog_join": "select r_name, n_name from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')",
    "key_index_join": "select n_regionkey as relation_id, n_name as name from nation where n_nationkey % 2 = 1",
    "pk_array_agg": "select n_regionkey, array_to_string(list_sort(list(n_name)), ', ') as names, count(*) as n from nation group by 1",
    "table_status": """
        with j as (
            select o_orderkey, l_orderkey, l_returnflag, l_linestatus, row_number() over (partition by o_orderkey order by l_shipdate desc nulls last,
                l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) rn
            from orders left join lineitem on o_orderkey = l_orderkey)
        select o_orderkey, case when l_orderkey is null then 'inactive' when l_returnflag = 'R' then 'expired' when l_returnflag = 'A' then 'complete'
            when l_linestatus = 'F' then 'error' else 'scheduled' end as import_status from j where rn = 1""",
    "job_backoff": "select o_orderkey, o_orderkey % 9 as error_count, least(3600.0::double, 5 * pow(3, o_orderkey % 9)) as delay_seconds from orders",
    "job_acquire": """
        select o_orderkey from orders where o_orderstatus = 'O' and (o_orderkey % 9 < 1
            or timestamp '1998-01-01 00:00:00' > o_orderdate + to_seconds(least(3600.0::double, 5 * pow(3, o_orderkey % 9))))
        order by (o_orderkey % 9 = 0) desc, o_orderkey limit 1""",
    "schema_fingerprint": """
        select r_regionkey, md5(string_agg('false|' || n_name || '|25|0' || chr(10), '' order by n_nationkey)) as fp
        from nation join region on n_regionkey = r_regionkey group by 1""",
    "publication_filter": "select p_partkey, p_brand from part where p_size in (1, 5, 10) and p_brand <> 'Brand#11'",
    "publication_reconcile": """
        select 'public' as "schema", coalesce(w.t, p.t) as table_name, case when p.t is null then 'add' else 'remove' end as action
        from (select distinct cast(c_custkey as varchar) t from customer where c_acctbal > 0) w
        full join (select distinct cast(o_custkey as varchar) t from orders where o_orderstatus = 'P') p on w.t = p.t
        where w.t is null or p.t is null""",
    "route_counts": """
        select ref, count(*) as n from (select 'public.orders' as ref from orders union all select 'public.customer' from customer
            union all select 'public.events' from events) group by ref""",
    "metrics_rate": "select date_trunc('hour', ts) as w, event_type, count(*) / 3600.0::double as rate from events group by 1, 2",
    "metrics_histogram": """
        select le, count(*) filter (where value <= le) as n from events, (select 0.125::double * pow(2, i) as le from range(12) t(i)) b group by le""",
    "metrics_heatmap": """
        select cast(date_trunc('day', ts) as timestamp) as w, le, count(*) filter (where value <= le) / 86400.0::double as rate
        from events, (select 0.125::double * pow(2, i) as le from range(9) t(i)) b group by 1, 2""",
    "metrics_quantiles": """
        with h as (
            select event_type, le, count(*) filter (where value <= le) as n
            from events, (select 1.0::double * pow(2, i) as le from range(13) t(i)) b group by 1, 2),
        p as (select *, lag(le, 1, 0.0) over w as low_le, lag(n, 1, 0) over w as low_n, max(n) over (partition by event_type) * 0.5 as rank
            from h window w as (partition by event_type order by le)),
        f as (select *, row_number() over (partition by event_type order by le) rn from p where n >= rank)
        select event_type, low_le + (le - low_le) * coalesce((rank - low_n) / nullif(n - low_n, 0), 0.0) as value from f where rn = 1""",
    "toast_carry_forward": """
        select event_id, user_id, last_value(case when event_type = 'view' then null else value end ignore nulls)
            over (partition by user_id order by ts rows unbounded preceding) as value from events""",
    "progress": """
        select o_orderkey, cast(floor(100.0::double * count(l_orderkey) / 12) as bigint) as pct
        from orders left join lineitem on o_orderkey = l_orderkey group by 1""",
    "txn_visible": "select max(event_id) as acked_lsn from events where event_id // 5 < (select max(event_id) // 5 from events)",
    "lsn_text": """
        select delivery_id, format('{:X}/{:X}', lsn >> 32, lsn & 4294967295) as lsn_text, lsn from modifications where lsn is not null""",
    "wal_entries": """
        select event_id, 'public.users' as ref, case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as operation,
            event_id // 5 * 5 + 4 as lsn, row_number() over (partition by event_id // 5 order by event_id) + 1 as sequence, user_id, value from events""",
}
SQL["streamed_entries"] = SQL["wal_entries"]

_TABLES = """
    t as (select distinct namespace as "schema", name as table_name from schema_entries where namespace is not null and name is not null)"""
_NEWEST = """
    n as (select * from (select *, row_number() over (partition by subscription_id, "schema", table_name order by created_at desc, id) as rn from import_jobs) where rn = 1)"""
_MISSING = f"""
    {_TABLES},
    m as (select * from t where not exists (
        select 1 from import_jobs j where j.subscription_id = 'sub_000000' and j.expired_at is null and j."schema" = t."schema" and j.table_name = t.table_name))"""


def _outcome_sql(which: str, **values: str) -> str:
    """Jobs as ``_outcome`` shows them, some columns replaced where a job is the one concerned."""
    shown = {
        "cursor": "cursor", "error": "error", "error_count": "error_count", "rows_processed_total": "rows_processed_total", "completed": "completed_at is not null",
        "expired": "expired_at is not null", "updated_us": "epoch_us(updated_at)", "last_error_us": "epoch_us(last_error_at)",
    }
    return "select id, " + ", ".join(f"case when {which} then {values[c]} else {old} end as {c}" if c in values else f"{old} as {c}" for c, old in shown.items()) + " from import_jobs"


_NOW_US = "1893456000000000"
SQL |= {
    "table_list": f"""
        with {_TABLES}, {_NEWEST}
        select t."schema", t.table_name, case when t."schema" = 'public' then 'active' else 'inactive' end as publication_status, s as import_status,
            case when s in ('expired', 'inactive') then 0 else coalesce(rows_processed_total, 0) end as rows_processed_total, error
        from (select t.*, n.rows_processed_total, n.error, case when n.id is null then 'inactive' when expired_at is not null then 'expired' when completed_at is not null then 'complete'
                when error is not null then 'error' when cursor is null then 'scheduled' else 'in_progress' end as s
            from t left join n on n.subscription_id = 'sub_000000' and n."schema" = t."schema" and n.table_name = t.table_name) t""",
    "newest_jobs": f'with {_NEWEST} select subscription_id, "schema", table_name, id, cursor, rows_processed_total from n',
    "jobs_by_table": """select "schema", table_name, string_agg(id, ',' order by created_at desc, id desc) as ids from import_jobs group by 1, 2""",
    "missing_jobs": f'with {_MISSING} select "schema", table_name from m',
    "created_jobs": f"""
        with {_MISSING}
        select (select coalesce(max(id), 0) from import_jobs) + row_number() over (order by "schema", table_name) as id, 'sub_000000' as subscription_id, "schema", table_name,
            cast(null as varchar) as cursor, 0::bigint as error_count, 0::bigint as rows_processed_total from m""",
    "job_succeeded": _outcome_sql("id = 22", cursor="'K17'", error="null", error_count="0", rows_processed_total="rows_processed_total + 17", completed="true", updated_us=_NOW_US),
    "job_failed": _outcome_sql("id = 22", error="'no route'", error_count="error_count + 1", updated_us=_NOW_US, last_error_us=_NOW_US),
    "job_expired": _outcome_sql(
        "subscription_id = 'sub_000000' and \"schema\" = 'tenant_000000' and table_name = 'tickets' and expired_at is null", expired="true", updated_us=_NOW_US
    ),
    "import_run": """
        select count(*) as landed, cast(sum(c_custkey) as bigint) as keys, 'customer' as name, 0::bigint as with_lsn, count(*) as rows, cast(max(c_custkey) as varchar) as cursor, true as complete
        from customer where c_custkey > 100""",
    "imported_rows": f"""
        select 'public.customer' as ref, {_NOW_US}::bigint as read_us, cast(null as bigint) as lsn, cast(null as bigint) as sequence, cast(null as varchar) as before,
            cast(c_custkey as varchar) as c_custkey, c_name from customer where c_custkey > 50""",
    "decoded_values": """
        select o_orderkey as int8, o_totalprice as "numeric", cast(o_orderdate as date) as date, date_trunc('second', o_orderdate) as "timestamp", o_orderstatus = 'O' as bool,
            '0A' || printf('%X', o_orderkey) || case when length(printf('%X', o_orderkey)) % 2 = 1 then '0' else '' end as bytea,
            o_orderkey || '/-/' || o_custkey as int8s, 'a ,' || o_orderstatus || '/-/x' as texts from orders""",
    "raw_tables": """
        select user_id, event_type, case when event_id >= 2000 then value end as value from (
            select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
        where rn = 1 and event_type <> 'error'""",
    "routed_operations": """
        select cast(cast(ts as date) as varchar) as day, case event_type when 'error' then 'DELETE' else 'UPDATE' end as operation, count(*) as n, max(event_id) as lsn from events group by 1, 2""",
    "json_sink": """
        select event_type, count(*) as n, max(event_id) as top, (select count(*) from events) as written, (select max(event_id) from events) as last_lsn from events group by 1""",
    "table_search": "select n_name as table_name from nation where lower(n_name) like '%nation_12%' or levenshtein(lower(n_name), 'nation_12') <= 1",
    "published_tables": "select 'public' as \"schema\", n_name as table_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
    "publication_edit": """
        select distinct 'public' as "schema", t as table_name from (
            select n_name as t from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE' union all select 'NEW' union all select 'NATION_3')
        where t <> 'NATION_8'""",
    "catalog_tables": """
        select r_name as "schema", n_name as table_name, n_nationkey as relation_id from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 <> 0""",
    "catalog_schemas": """
        with a as (
            select c_nationkey as r, case when c_custkey % 10 = 0 then -1 else c_custkey end as num, c_name, c_custkey % 7 = 0 as dropped from customer where c_custkey <= 200),
        k as (select r, max(num) as num from a group by 1)
        select n_nationkey as relation_id, r_name as namespace, n_name as name, string_agg(c_name || case when a.num = k.num then '*' else '' end, ',' order by a.num) as columns
        from nation join region on n_regionkey = r_regionkey join a on a.r = n_nationkey join k on k.r = a.r where a.num > 0 and not dropped group by 1, 2, 3""",
    "primary_keys": """
        with c as (select entry_id, unnest(json_extract(spec, '$.columns[*]')) as col, generate_subscripts(json_extract(spec, '$.columns[*]'), 1) as pos from schema_entries)
        select e.entry_id, coalesce(k.keys, '') as keys from schema_entries e
            left join (select entry_id, string_agg(col->>'$.name', ',' order by pos) as keys from c where col->>'$.key' = 'true' group by 1) k using (entry_id)""",
    "base_tables": "select 'public' as \"schema\", n_name as table_name from nation where n_nationkey % 3 = 1",
    "last_positions": "select arg_max(lsn, delivery_id) as lsn from modifications where lsn is not null",
    "text_forms": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, event_type || '_' || user_id as slot from events",
    "event_quantiles": "select l_returnflag, quantile_disc(l_quantity, 0.5) as p50, quantile_disc(l_quantity, 0.9) as p90 from lineitem group by 1",
}

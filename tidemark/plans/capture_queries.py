"""Queries of the change-capture problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import entries_json
from ..functions.storage import Storage, workspace
from ..operators.bucketed_table import BucketedTable
from ..operators.history import HistoryStore
from ..operators.incremental import RECORD, IncrementalRun, changed_jobs, open_imports, pending_offsets, untaken_records
from ..operators.row_events import left_out, row_events, with_keys
from ..operators.schema_registry import SchemaRegistry
from ..streaming.deduplicate import Deduplicator
from .tables import dealt, table


def _present(spark: SparkSession, d: str) -> DataFrame:
    at = workspace(spark, "present")
    mods = dealt(spark, d, "modifications", "file_no", "timestamp", "namespace", "name", "lsn", "sequence", "before", "after")
    keyed = with_keys(mods, table(spark, d, "schema_entries"), f"{at}/keys")
    state = BucketedTable(spark, f"{at}/table")
    state.apply(row_events(keyed.where("lsn is null")), "imports")
    state.apply(row_events(keyed.where("lsn is not null")), "changes")
    return state.rows()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source rows that exist at the end, with the last change of each."""
    return _present(spark, d).select("namespace", "name", "row_key", "lsn", "sequence")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The present rows of every source table, with their images."""
    return _present(spark, d).select("namespace", "name", "row_key", F.col("after").alias("image"))


def p1_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that name no row, by table and reason."""
    mods = dealt(spark, d, "modifications", "file_no", "timestamp", "namespace", "name", "lsn", "sequence", "before", "after")
    return left_out(with_keys(mods, table(spark, d, "schema_entries"), f"{workspace(spark, 'left-out')}/keys"))


CHANGE = ["namespace", "name", "lsn", "sequence"]
#: Batches in which the deliveries are taken, and bytes of their files from which on there are more.
BATCHES, BATCH_BYTES = 3, 64 << 30


def _deduplicated(spark: SparkSession, d: str, payload: list[str]) -> Deduplicator:
    run = Deduplicator(spark, workspace(spark, "deduplicate"), CHANGE, "received_at", "delivery_id", "lsn", delay="6 hours", payload=payload)
    batches = max(BATCHES, -(-Storage(spark).size(f"{d}/modifications.parquet") // BATCH_BYTES))
    run.replay(dealt(spark, d, "modifications", *CHANGE, "received_at", "delivery_id", *payload).where("lsn is not null"), batches)
    return run


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes delivered more than once."""
    return _deduplicated(spark, d, []).repeats()


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each change: of its deliveries in the first batch that has any, that with the least number."""
    return _deduplicated(spark, d, ["timestamp", "before", "after"]).kept().select(*CHANGE, F.unix_micros("timestamp").alias("committed_us"), "before", "after")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next sink run still has to take: changes, imported rows and import jobs."""
    at = workspace(spark, "incremental")
    mods, runs, jobs = (table(spark, d, x) for x in ("modifications", "sink_runs", "import_jobs"))
    run = IncrementalRun(spark, f"{at}/run")
    number = run.plan(lambda: {"offsets": pending_offsets(mods, runs), "imports": open_imports(jobs, numbered=True), "jobs": changed_jobs(jobs, runs)})
    columns = ["subscription_id", "file_no", "timestamp", "namespace", "name", "lsn", "sequence", "before", "after"]
    keyed = with_keys(mods.select(*columns), table(spark, d, "schema_entries"), f"{at}/keys")
    run.execute(number, lambda plan: untaken_records(plan, keyed, at))
    return run.records().select(*RECORD)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each column change that a schema entry of the log brings."""
    registry = SchemaRegistry(table(spark, d, "schema_entries"), workspace(spark, "schemas"))
    return registry.steps().select("namespace", "name", "lsn", "column_name", "change")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """All modifications with their row images in the final schema of their table."""
    registry = SchemaRegistry(table(spark, d, "schema_entries"), workspace(spark, "schemas"))
    mods = dealt(spark, d, "modifications", "delivery_id", "namespace", "name", "lsn", "timestamp", "before", "after")
    unified = registry.unify(mods, ["delivery_id"])
    return unified.select("delivery_id", "namespace", "name", "lsn", entries_json(F.col("attributes")).alias("attributes"), F.array_join("misfits", ",").alias("misfits"))


def _history(spark: SparkSession, d: str) -> HistoryStore:
    at = workspace(spark, "history")
    mods = dealt(spark, d, "modifications", "file_no", "timestamp", "namespace", "name", "lsn", "sequence", "before", "after")
    store = HistoryStore(spark, f"{at}/store")
    store.apply(row_events(with_keys(mods, table(spark, d, "schema_entries"), f"{at}/keys")))
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every source row, with its period."""
    return _history(spark, d).versions().select("namespace", "name", "row_key", "valid_from", "valid_to")


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same with the attributes of each version."""
    return _history(spark, d).versions().withColumn("attributes", entries_json(F.col("attributes")))


QUERIES = {
    "p1_found": p1_found,
    "p1_rows": p1_rows,
    "p1_left_out": p1_left_out,
    "p2_found": p2_found,
    "p2_kept": p2_kept,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p5_found": p5_found,
    "p5_versions": p5_versions,
}
_KEYS = """
    k as (
        select namespace, name, min(c->>'$.name') as kc, min(c->>'$.type') as kt
        from (select namespace, name, unnest(json_extract(spec, '$.columns[*]')) as c from schema_entries) where c->>'$.key' = 'true' group by all)"""
_EVENTS = f"""
    {_KEYS},
    m as (
        select m.namespace, m.name, epoch_us("timestamp") as ts, lsn is not null as ch, coalesce(lsn, 0) as lsn, coalesce(sequence, 0) as sequence, after,
            json_extract_string(before, '$."' || kc || '"') as bk, json_extract_string(after, '$."' || kc || '"') as ak
        from modifications m join k using (namespace, name)),
    e as (
        select namespace, name, ak as row_key, ts, ch, lsn, sequence, true as alive, after from m where ak is not null
        union all select namespace, name, bk, ts, ch, lsn, sequence, false, null from m where bk is not null and bk is distinct from ak)"""

SQL: dict[str, str] = {
    "p1_found": f"""
        with {_EVENTS}
        select namespace, name, row_key, lsn, sequence from (
            select *, row_number() over (partition by namespace, name, row_key order by ts desc, ch desc, lsn desc, sequence desc) as rn from e)
        where rn = 1 and alive""",
    "p1_left_out": f"""
        with {_KEYS},
        m as (
            select m.namespace, m.name, kc, json_type(after) as a_type, json_type(before) as b_type, json_extract_string(before, '$."' || kc || '"') as bk, json_extract_string(after, '$."' || kc || '"') as ak
            from modifications m left join k using (namespace, name)),
        w as (
            select namespace, name, case when kc is null then 'no key column' when a_type is distinct from 'OBJECT' and b_type is distinct from 'OBJECT' then 'no image'
                when ak is null and bk is null then 'no key value' end as reason from m)
        select namespace, name, reason, count(*) as deliveries from w where reason is not null group by all""",
    "p1_rows": f"""
        with {_EVENTS}
        select namespace, name, row_key, after as image from (
            select *, row_number() over (partition by namespace, name, row_key order by ts desc, ch desc, lsn desc, sequence desc, alive desc, after desc) as rn from e)
        where rn = 1 and alive""",
    "p2_found": """
        select namespace, name, lsn, sequence from modifications where lsn is not null
        group by namespace, name, lsn, sequence having count(*) > 1""",
    "p2_kept": f"""
        with b as (select min(epoch_us(received_at)) as low, max(epoch_us(received_at)) as high from modifications where lsn is not null),
        s as (
            select m.*, (coalesce(epoch_us(received_at), 0) - low) * {BATCHES} // (high - low + 1) as slice from modifications m, b where lsn is not null),
        r as (select *, row_number() over (partition by namespace, name, lsn, sequence order by slice, delivery_id) as rn from s)
        select namespace, name, lsn, sequence, epoch_us("timestamp") as committed_us, before, after from r where rn = 1""",
    "p3_found": f"""
        with {_KEYS},
        r as (
            select subscription_id, run_id, arg_max(state, logged_at) as state, min(first_file) as f, max(last_file) as l,
                min(case when state = 'started' then logged_at end) as started from sink_runs group by all),
        t as (
            select m.*, exists (select 1 from r where r.state = 'success' and r.subscription_id = m.subscription_id and m.file_no between f and l) as taken
            from modifications m),
        j as (
            select * from (select *, row_number() over (partition by "schema", table_name order by created_at desc, id desc) as rn from import_jobs)
            where rn = 1 and completed_at is null and expired_at is null),
        i as (
            select m.namespace, m.name, json_extract_string(after, '$."' || kc || '"') as v, kt, j.cursor
            from modifications m join k using (namespace, name) join j on j."schema" = m.namespace and j.table_name = m.name where m.lsn is null),
        s as (select subscription_id, max(started) as started from r where state = 'success' group by 1)
        select 'change' as kind, namespace, name, lsn || '/' || sequence as record_key from t where lsn is not null
        group by namespace, name, lsn, sequence having not bool_or(taken)
        union all
        select distinct 'row', namespace, name, v from i
        where cursor is null or cursor = '' or case when kt in ('20', '21', '23', 'int2', 'int4', 'int8') then cast(v as bigint) > try_cast(cursor as bigint) else v > cursor end
        union all
        select 'job', "schema", table_name, cast(id as varchar) from import_jobs left join s using (subscription_id) where s.started is null or updated_at > s.started""",
    "p4_found": """
        with c as (
            select entry_id, namespace, name, lsn, "timestamp" as ts, unnest(json_extract(spec, '$.columns[*]')) as col,
                generate_subscripts(json_extract(spec, '$.columns[*]'), 1) as pos from schema_entries where lsn is not null),
        t(oid, tn) as (values ('16', 'bool'), ('20', 'int8'), ('21', 'int2'), ('23', 'int4'), ('25', 'text'), ('701', 'float8'), ('1043', 'varchar'), ('1082', 'date'),
            ('1184', 'timestamptz'), ('1700', 'numeric')),
        x as (
            select entry_id, namespace, name, lsn, ts, list({'n': col->>'$.name', 't': coalesce(tn, col->>'$.type')} order by pos) as now
            from c left join t on oid = col->>'$.type' group by all),
        y as (select *, lag(now) over (partition by namespace, name order by lsn, ts, entry_id) as was from x),
        z as (select *, list_transform(now, lambda v: v.n) as names, list_transform(was, lambda v: v.n) as old_names from y where was is not null and was <> now),
        n as (
            select *, not list_contains(old_names, cur.n) as is_new, pos <= len(was) and not list_contains(names, was[pos].n) and was[pos].t = cur.t as fits
            from (select *, unnest(now) as cur, generate_subscripts(now, 1) as pos from z)),
        o as (select *, unnest(was) as old, generate_subscripts(was, 1) as pos from z)
        select namespace, name, lsn, cur.n as column_name, 'renamed' as change from n where is_new and fits
        union all select namespace, name, lsn, cur.n, 'added' from n where is_new and not fits
        union all select namespace, name, lsn, cur.n, 'retyped' from n where not is_new and list_filter(was, lambda v: v.n = cur.n)[1].t <> cur.t
        union all
        select o.namespace, o.name, o.lsn, old.n, 'removed' from o where not list_contains(names, old.n)
            and not (pos <= len(now) and not list_contains(old_names, now[pos].n) and now[pos].t = old.t)""",
    "p5_found": f"""
        with {_EVENTS},
        l as (
            select *, case when alive then list_sort(list_filter(
                list_transform(json_keys(after), lambda x: x || '=' || json_extract_string(after, '$."' || x || '"')), lambda v: v is not null)) end as state
            from (select *, row_number() over (partition by namespace, name, row_key, ts order by ch desc, lsn desc, sequence desc) as rn from e) where rn = 1),
        w as (select *, lag(state) over (partition by namespace, name, row_key order by ts) as was from l),
        c as (
            select *, lead(ts) over (partition by namespace, name, row_key order by ts) as until from w where state is distinct from was)
        select namespace, name, row_key, ts as valid_from, coalesce(until, 0) as valid_to from c where alive""",
    "p5_versions": f"""
        with {_EVENTS},
        l as (
            select *, case when alive then list_sort(list_filter(
                list_transform(json_keys(after), lambda x: x || '=' || json_extract_string(after, '$."' || x || '"')), lambda v: v is not null)) end as state,
                '{{' || array_to_string(list_transform(list_filter(list_sort(json_keys(after)), lambda x: json_extract_string(after, '$."' || x || '"') is not null),
                    lambda x: to_json(x) || ':' || to_json(json_extract_string(after, '$."' || x || '"'))), ',') || '}}' as attributes
            from (select *, row_number() over (partition by namespace, name, row_key, ts order by ch desc, lsn desc, sequence desc) as rn from e) where rn = 1),
        w as (select *, lag(state) over (partition by namespace, name, row_key order by ts) as was from l),
        c as (
            select *, lead(ts) over (partition by namespace, name, row_key order by ts) as until from w where state is distinct from was)
        select namespace, name, row_key, ts as valid_from, coalesce(until, 0) as valid_to, attributes from c where alive""",
}

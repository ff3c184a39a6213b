import pytest

from tidemark.operators.incremental import IncrementalRun, beyond, changed_jobs, open_imports, pending_offsets, runs, untaken_records
from tidemark.operators.row_events import with_keys

from .capture import DOGS, MODIFICATIONS, SCHEMAS, at_second, change, schema_entry

RUNS = "run_id bigint, subscription_id string, state string, logged_at timestamp, first_file bigint, last_file bigint, confirmed_lsn bigint"
JOBS = (
    "id bigint, subscription_id string, table_name string, cursor string, completed_at timestamp, expired_at timestamp, updated_at timestamp, created_at timestamp, "
    "error string, schema string, error_count bigint, last_error_at timestamp, rows_processed_total bigint"
)


def run_row(run, state, second, first, last, sub="s"):
    return (run, sub, state, at_second(second), first, last, None)


def job(n, cursor=None, completed=None, expired=None, updated=0, created=0, name="dogs", sub="s"):
    return (n, sub, name, cursor, completed and at_second(completed), expired and at_second(expired), at_second(updated), at_second(created), None, "public", 0, None, 0)


def files(spark, *numbers, sub="s"):
    return spark.createDataFrame([change(i, 1, 10 + i, None, {"id": i}, file_no=f, sub=sub) for i, f in enumerate(numbers)], MODIFICATIONS)


def test_latest_state_counts(spark):
    log = [
        *[run_row(1, s, t, 1, 3) for s, t in (("started", 1), ("success", 2), ("success", 2))],
        *[run_row(2, s, t, 4, 4) for s, t in (("success", 5), ("started", 4), ("reverted", 6))],
        run_row(3, "started", 7, 5, 5),
        *[run_row(4, s, 9, 6, 6) for s in ("success", "reverted")],  # at one instant
        run_row(5, "success", 9, 7, 7),
    ]
    got = {r["run_id"]: (r["state"], r["started_at"] and r["started_at"].second) for r in runs(spark.createDataFrame(log, RUNS)).collect()}
    assert got == {1: ("success", 1), 2: ("reverted", 4), 3: ("started", 7), 4: ("reverted", None), 5: ("success", None)}


def test_pending_offsets(spark):
    log = [run_row(1, "success", 1, 2, 3000), run_row(2, "success", 2, 2999, 4000), run_row(3, "failed", 3, 4001, 5000), run_row(4, "success", 4, 1, 9000, "other"), run_row(5, "success", 4, None, 9000), run_row(6, "success", 4, 9, 5)]
    got = pending_offsets(files(spark, 1, 2, 1500, 3000, 4000, 4001, 9001, 2), spark.createDataFrame(log, RUNS))
    assert sorted(r["file_no"] for r in got.collect()) == [1, 4001, 9001]
    assert pending_offsets(files(spark, 1), spark.createDataFrame([], RUNS)).count() == 1
    assert pending_offsets(files(spark), spark.createDataFrame(log, RUNS)).count() == 0
    # A range far wider than the log is cut to it.
    assert pending_offsets(files(spark, 7), spark.createDataFrame([run_row(1, "success", 1, 0, 1 << 50)], RUNS)).count() == 0


def test_newest_job_and_cursors(spark):
    jobs = spark.createDataFrame([job(1, "5", created=1), job(2, "7", created=2), job(3, "9", created=2, name="cats", expired=1), job(4, None, created=1, name="cats"), job(5, None, name="owls", completed=3)], JOBS)
    assert [tuple(r) for r in open_imports(jobs).collect()] == [("public", "dogs", "7")]
    cases = [
        ("10", "9", "int8", True), ("9", "10", "int8", False), ("9", "9", "int8", False), ("b", "a", "text", True), ("10", "9", "text", False), ("1", None, "int8", True),
        ("1", "", "int8", True), ("1.5", "1.25", "numeric", True), ("2024-01-02", "2024-01-01", "date", True), ("1", "x", "int8", True), ("é", "z", "varchar", True), ("2", "10", "float8", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k string, c string, t string, e boolean")
    assert all(r["got"] == r["e"] for r in df.select("*", beyond(df["k"], df["c"], df["t"]).alias("got")).collect())


def test_changed_jobs(spark):
    log = [run_row(1, "started", 10, 1, 1), run_row(1, "success", 11, 1, 1), run_row(2, "started", 20, 2, 2), run_row(2, "failed", 21, 2, 2)]
    jobs = spark.createDataFrame([job(1, updated=10), job(2, updated=11), job(3, updated=5, sub="new"), job(4, updated=30)], JOBS)
    assert sorted(r["id"] for r in changed_jobs(jobs, spark.createDataFrame(log, RUNS)).collect()) == [2, 3, 4]


def taken(spark, at, mods, log, jobs, name="run"):
    mods, log, jobs = spark.createDataFrame(mods, MODIFICATIONS), spark.createDataFrame(log, RUNS), spark.createDataFrame(jobs, JOBS)
    run = IncrementalRun(spark, f"{at}/{name}")
    number = run.plan(lambda: {"offsets": pending_offsets(mods, log), "imports": open_imports(jobs), "jobs": changed_jobs(jobs, log)})
    other = schema_entry(2, 0, 1, [("id", 25, True)], name="cats")
    keyed = with_keys(mods, spark.createDataFrame([DOGS, other], SCHEMAS), f"{at}/keys")
    run.execute(number, lambda plan: untaken_records(plan, keyed, f"{at}/{number}"))
    return run, {tuple(r)[:4] for r in run.records().collect()}


def test_untaken_records(spark, at):
    mods = [
        change(1, 1, 10, None, {"id": 1}, file_no=1), change(2, 1, 10, None, {"id": 1}, file_no=2),  # one of two deliveries was taken
        change(3, 1, 11, None, {"id": 1}, file_no=2), change(4, 1, 11, None, {"id": 1}, file_no=3), change(5, 1, 12, None, {"id": 1}, file_no=2, sequence=None),
        change(6, 1, None, None, {"id": 5}), change(7, 1, None, None, {"id": 10}), change(8, 2, None, None, {"id": 10}),
        change(9, 1, None, None, {"id": "b"}, name="cats"), change(10, 1, 13, None, "junk", file_no=9, name=None),
    ]
    log = [run_row(1, "started", 1, 1, 1), run_row(1, "success", 2, 1, 1)]
    _, got = taken(spark, at, mods, log, [job(1, "9", updated=1, created=1), job(2, None, updated=9, created=1, name="cats", completed=1)])
    assert got == {("change", "public", "dogs", "11/1"), ("change", "public", "dogs", "12/0"), ("change", "public", None, "13/1"), ("row", "public", "dogs", "10"), ("job", "public", "cats", "2")}
    _, got = taken(spark, at, [], [], [], "empty")
    assert got == set()


def test_plan_is_replayed_as_written_and_records_are_put_in_once(spark, at):
    record = "kind string, namespace string, name string, record_key string, offset bigint"
    run = IncrementalRun(spark, f"{at}/r")
    first = run.plan(lambda: {"t": spark.createDataFrame([("change", None, "a", "1", 1), ("change", None, "a", "1", 1)], record)})
    # The run dies here. Another begins when the log has grown: it gets the plan that was written.
    again = IncrementalRun(spark, f"{at}/r")
    assert again.plan(lambda: 1 / 0) == first == 0
    again.execute(0, lambda p: p["t"])
    again.execute(0, lambda p: 1 / 0)  # committed: nothing to do
    assert again.records().count() == 1
    second = again.plan(lambda: {"t": spark.createDataFrame([("change", None, "a", "1", 1), ("change", None, "a", "1", 2), ("row", "n", "a", "x", 0)], record)})
    again.execute(second, lambda p: p["t"])
    assert sorted((r["kind"], r["record_key"], r["offset"]) for r in again.records().collect()) == [("change", "1", 1), ("change", "1", 2), ("row", "x", 0)]


def test_deliveries_without_file_or_subscription_are_untaken(spark, at):
    mods = [
        change(1, 1, 10, None, {"id": 1}, file_no=None), change(2, 1, 11, None, {"id": 1}, file_no=5, sub=None), change(3, 1, 12, None, {"id": 1}, file_no=None, sub=None),
        change(4, 1, 13, None, {"id": 1}, file_no=1), change(5, 1, 13, None, {"id": 1}, file_no=None), change(6, 1, 14, None, {"id": 1}, file_no=0, sub=""),
    ]
    log = [run_row(1, "started", 1, 0, 9), run_row(1, "success", 2, 0, 9), run_row(2, "success", 2, 0, 9, "")]
    _, got = taken(spark, at, mods, log, [])
    assert got == {("change", "public", "dogs", f"{lsn}/1") for lsn in (10, 11, 12)}


def test_a_newer_import_job_takes_its_rows_again(spark, at):
    mods = spark.createDataFrame([change(1, 1, None, None, {"id": 1}), change(2, 1, None, None, {"id": 2})], MODIFICATIONS)
    keyed, run = with_keys(mods, spark.createDataFrame([DOGS], SCHEMAS), f"{at}/keys"), IncrementalRun(spark, f"{at}/run")
    none, counts = spark.createDataFrame([], RUNS), []
    for jobs in ([job(1, "1")], [job(1, "1")], [job(1, "1", completed=1), job(2, None, created=2)]):
        table = spark.createDataFrame(jobs, JOBS)
        number = run.plan(lambda: {"offsets": pending_offsets(mods, none), "imports": open_imports(table, numbered=True), "jobs": changed_jobs(table, none)})
        run.execute(number, lambda plan: untaken_records(plan, keyed, f"{at}/{number}"))
        counts.append(sorted((r["record_key"], r["offset"]) for r in run.records().where("kind = 'row'").collect()))
    assert counts == [[("2", 1)], [("2", 1)], [("1", 2), ("2", 1), ("2", 2)]]


def test_two_batches_with_a_crash_between(spark, at, monkeypatch):
    """The second run dies after its records are written and before its commit; the next replays its plan though the log has grown, and puts nothing in twice."""
    mods = [change(i, 1, 100 + i, None, {"id": i}, file_no=i // 5) for i in range(20)]
    log = [run_row(1, "started", 1, 0, 1), run_row(1, "success", 2, 0, 1)]
    table = lambda rows: spark.createDataFrame(rows, MODIFICATIONS)
    runs, jobs, entries = spark.createDataFrame(log, RUNS), spark.createDataFrame([], JOBS), spark.createDataFrame([DOGS], SCHEMAS)

    def batch(run, deliveries):
        number = run.plan(lambda: {"offsets": pending_offsets(deliveries, runs), "imports": open_imports(jobs, numbered=True), "jobs": changed_jobs(jobs, runs)})
        run.execute(number, lambda plan: untaken_records(plan, with_keys(deliveries, entries, f"{at}/keys"), f"{at}/{number}"))
        return number

    def keys(run):
        return sorted(r["record_key"] for r in run.records().collect())

    run = IncrementalRun(spark, f"{at}/run")
    assert batch(run, table(mods)) == 0 and keys(run) == [f"{100 + i}/1" for i in range(10, 20)]
    more = mods + [change(100 + i, 1, 110 + i, None, {"id": i}, file_no=7) for i in range(15)]
    create = run.fs.create
    monkeypatch.setattr(run.fs, "create", lambda path, value: (_ for _ in ()).throw(OSError("lost")) if "/commits/" in path else create(path, value))
    with pytest.raises(OSError, match="lost"):
        batch(run, table(more))
    run = IncrementalRun(spark, f"{at}/run")
    assert keys(run) == [f"{100 + i}/1" for i in range(10, 20)]
    grown = table([*more, change(500, 1, 900, None, {"id": 1}, file_no=8)])
    assert batch(run, grown) == 1 and keys(run) == [f"{100 + i}/1" for i in range(10, 25)]  # 110 to 119 were in the sink
    assert run.fs.load(f"{run.path}/commits/{1:09d}.json")["compared_with"] == [0]
    assert batch(run, grown) == 2 and keys(run) == [f"{100 + i}/1" for i in range(10, 25)] + ["900/1"]


def test_scans_are_told_what_is_pending(spark, at):
    spark.createDataFrame([change(i, 1, 100 + i, None, {"id": i}, file_no=i // 5) for i in range(50)], MODIFICATIONS).write.parquet(f"{at}/log")
    mods = spark.read.parquet(f"{at}/log")
    runs = spark.createDataFrame([run_row(1, "started", 1, 0, 7), run_row(1, "success", 2, 0, 7)], RUNS)
    jobs = spark.createDataFrame([], JOBS)
    keyed = with_keys(mods, spark.createDataFrame([DOGS], SCHEMAS), f"{at}/keys")
    found = untaken_records({"offsets": pending_offsets(mods, runs), "imports": open_imports(jobs), "jobs": changed_jobs(jobs, runs)}, keyed, f"{at}/p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lsn,140), LessThanOrEqual(lsn,149)" in plan
    assert found.where("kind = 'change'").count() == 10

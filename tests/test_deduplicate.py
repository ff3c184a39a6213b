import os
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.streaming.deduplicate import Deduplicator, collapsed

from .capture import MODIFICATIONS, at_second, change

KEYS = ["namespace", "name", "lsn", "sequence"]
DAY = 86_400


def write_files(spark, files, folder):
    """A Parquet file for each list of deliveries, older files first."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, MODIFICATIONS).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder.removeprefix("file://")):
            path = os.path.join(folder.removeprefix("file://"), name)
            if os.path.getmtime(path) > 10_000_000_000 / 4:  # not yet dated
                os.utime(path, (1_000_000_000 + i * 10, 1_000_000_000 + i * 10))


def run(spark, folder, path, **options):
    source = spark.readStream.schema(MODIFICATIONS).option("maxFilesPerTrigger", 1).parquet(folder).where("lsn is not null")
    d = Deduplicator(spark, path, KEYS, "received_at", "delivery_id", "lsn", **options)
    d.run(source)
    return d


def delivered(n, lsn, received, **more):
    return change(n, 0, lsn, None, {"id": 1}, received=received, **more)


def check(d, files):
    counts = Counter((r[5], r[6], r[7], r[8]) for f in files for r in f if r[7] is not None)
    kept = [tuple(r[c] for c in KEYS) for r in d.kept().collect()]
    assert len(kept) == len(set(kept)) and set(kept) == set(counts)
    assert {tuple(r) for r in d.repeats().collect()} == {k for k, n in counts.items() if n > 1}
    ids = {r[0] for f in files for r in f}
    assert all(r["delivery_id"] in ids for r in d.kept().collect())


def test_repeats_in_one_batch_and_in_several(spark, at):
    files = [[delivered(1, 10, 1), delivered(2, 10, 2), delivered(3, 11, 3)], [delivered(4, 11, 4), delivered(5, 12, 5)], [delivered(6, None, 6), delivered(7, 10, 7)]]
    write_files(spark, files, f"{at}/in")
    check(run(spark, f"{at}/in", f"{at}/d"), files)


def test_forgotten_identifiers_and_late_deliveries_are_looked_up(spark, at):
    files = [
        [delivered(1, 10, 0), delivered(2, 11, 1)],
        [delivered(3, 500, 30 * DAY)],
        [delivered(4, 501, 31 * DAY)],  # the store has forgotten 10 and 11 by now
        [delivered(5, 10, 32 * DAY), delivered(6, 502, 32 * DAY)],  # a repeat of a forgotten one, on time
        [delivered(7, 12, 2), delivered(8, 11, 3), delivered(9, 503, 33 * DAY), delivered(10, 12, 4)],  # late: one new, one a repeat
    ]
    write_files(spark, files, f"{at}/in")
    check(run(spark, f"{at}/in", f"{at}/d", delay="1 day"), files)


def test_run_goes_on_after_a_failure_and_takes_new_files(spark, at):
    files = [[delivered(1, 10, 1)], [delivered(2, 10, 2), delivered(3, 11, 3)]]
    write_files(spark, files, f"{at}/in")
    broken = Deduplicator(spark, f"{at}/d", KEYS, "received_at", "delivery_id", "lsn")
    create, calls = broken.fs.create, []

    def fail_second(path, value):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")
        return create(path, value)

    broken.fs.create = fail_second
    with pytest.raises(Exception, match="lost"):
        broken.run(spark.readStream.schema(MODIFICATIONS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    d = run(spark, f"{at}/in", f"{at}/d")
    check(d, files)
    more = [*files, [delivered(4, 11, 4), delivered(5, 13, 5)]]
    write_files(spark, more[2:], f"{at}/in")
    check(run(spark, f"{at}/in", f"{at}/d"), more)


def test_nulls_payload_and_names(spark, at):
    files = [[delivered(1, 10, 1, name=None), delivered(2, 10, 2, name=None), change(3, 0, 10, None, {"id": 2}, sequence=None), (4, "s", 1, None, at_second(1), "public", "dogs", 99, 1, None, None)]]
    write_files(spark, files, f"{at}/in")
    d = run(spark, f"{at}/in", f"{at}/d", payload=["after"])
    check(d, files)
    assert {r["after"] for r in d.kept().collect()} == {'{"id": 1}', '{"id": 2}', None}
    with pytest.raises(ValueError, match="copies"):
        Deduplicator(spark, f"{at}/e", ["copies"], "received_at", "delivery_id", "lsn")


def test_no_deliveries(spark, at):
    write_files(spark, [[]], f"{at}/in")
    d = run(spark, f"{at}/in", f"{at}/d")
    assert d.kept().count() == 0 and d.repeats().count() == 0
    os.makedirs(f"{at}/none".removeprefix("file://"))
    d = run(spark, f"{at}/none", f"{at}/d2")
    assert d.kept().count() == 0 and d.repeats().count() == 0


def test_settings_are_put_back(spark, at):
    write_files(spark, [[delivered(1, 10, 1)]], f"{at}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, f"{at}/in", f"{at}/d")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_copies_in_a_batch_are_collapsed():
    batch = pa.record_batch({"k": [1, None, 1, None, 2], "c": [5, 4, 3, 2, 1]})
    (out,) = collapsed([batch], ["k"], "c")
    assert sorted(zip(*(out.column(x).to_pylist() for x in ("c", "copies")))) == [(1, 1), (2, 2), (3, 2)]

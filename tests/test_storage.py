from pyspark.sql import functions as F

from tidemark.functions import storage


def test_create_is_whole_and_only_once(spark, at):
    fs = storage.Storage(spark)
    assert fs.create(f"{at}/a/m.json", {"x": 1})
    assert not fs.create(f"{at}/a/m.json", {"x": 2})
    assert fs.load(f"{at}/a/m.json") == {"x": 1}
    assert [x for x in fs.names(f"{at}/a") if not x.startswith(".")] == ["m.json"]
    assert fs.names(f"{at}/none") == [] and fs.size(f"{at}/none") == 0


def test_workspace_is_in_the_shared_folder(spark):
    assert storage.workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert storage.workspace(spark, "x") != storage.workspace(spark, "x")


def test_attach_beyond_the_size_that_is_broadcast(spark, at, monkeypatch):
    left = spark.createDataFrame([(1, i, "clash") for i in range(100)] + [(2, 1, None), (None, 2, None)], "k int, n int, v string")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    rows = {}
    for most in (1 << 20, 0):
        monkeypatch.setattr(storage, "BROADCAST_BYTES", most)
        joined = storage.attach(left, right, f"{at}/{most}", ["k"], ["n"])
        plan = joined._jdf.queryExecution().simpleString()
        assert ("ResolvedHint" in joined._jdf.queryExecution().logical().toString()) == (most > 0), plan
        rows[most] = sorted(map(str, joined.select("k", "n", "v").collect()))
    assert rows[0] == rows[1 << 20] and len(rows[0]) == 102
    assert joined.where(F.col("v") == "a").count() == 100

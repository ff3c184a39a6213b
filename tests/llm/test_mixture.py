import numpy as np
import pandas as pd
import pytest

from tidemark.llm.mixture import VOCABULARY, Mixture, _split, draw_plan, token_counts

TARGETS = "source string, target_share double, max_repeats bigint"
DOCS = "doc_id bigint, text string, source string"


def mixture(spark, at, docs, targets, **options):
    documents = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as tokens", "'x' as block", "2 as shard")
    return Mixture(documents, spark.createDataFrame(targets, TARGETS), at, **options)


def test_tokens_of_whole_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    texts = ["The carrier's barley, 1,200 crowns.", "", None, "é <|endoftext|> \n\n 日本", "word " * 20_000]
    rows = {r["doc_id"]: r for r in token_counts(spark.createDataFrame([(i, t, " A ") for i, t in enumerate(texts)] + [(9, "x", None)], DOCS)).collect()}
    assert len(rows) == 5 and rows[0]["source"] == "a"
    for i, t in enumerate(texts):
        assert rows[i]["tokens"] == len(reference.encode(t or "", add_special_tokens=False).ids)


def test_tree_gives_every_block_once_at_every_cut():
    rng = np.random.default_rng(1)
    counts = np.array([100, 7, 0, 31])
    for shards in (1, 2, 3, 7, 64, 200):
        cuts = _split(counts, shards, rng)
        assert cuts.shape == (shards, 4) and (cuts.sum(axis=0) == counts).all() and (cuts >= 0).all()
        assert cuts.sum(axis=1).max() - cuts.sum(axis=1).min() <= np.ceil(np.log2(shards)) + 1
    means = np.mean([_split(np.array([60, 20]), 4, rng)[0] for _ in range(400)], axis=0)
    assert abs(means[0] - 15) < 0.5 and abs(means[1] - 5) < 0.5


def test_plan_reaches_quotas_exactly():
    rng = np.random.default_rng(2)
    blocks = pd.DataFrame([(s, b, int(t)) for s, n in (("a", 50), ("b", 5), (None, 20)) for b, t in enumerate(rng.integers(1, 1000, n))], columns=["source", "block", "tokens"])
    targets = pd.DataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("none", 0.3, 9)], columns=["source", "target_share", "max_repeats"])
    plan, quotas = draw_plan(blocks, targets, 8, 1)
    size = plan.merge(blocks, on=["source", "block"])
    size["taken"] = size["limit"].fillna(size["tokens"])
    total, own = blocks["tokens"].sum(), blocks.groupby("source")["tokens"].sum()
    taken = size.groupby("source")["taken"].sum()
    assert taken["a"] == round(0.2 * total) and taken["b"] == min(round(0.5 * total), 3 * own["b"])
    assert not plan.duplicated(["source", "block", "pass"]).any() and plan["pass"].max() <= 2
    assert quotas.set_index("source").loc["none", "quota"] == 0
    again, _ = draw_plan(blocks, targets, 8, 1)
    assert again.equals(plan)


def test_shares_repeats_and_shards(spark, at):
    docs = [(i, "word " * (5 + i % 7), "Big ") for i in range(300)] + [(1000 + i, "word " * 10, " small") for i in range(20)] + [(5000, "word", None), (5001, None, "big"), (5002, "lone text", "untargeted")]
    m = mixture(spark, at, docs, [("big", 0.5, 1), ("SMALL", 0.4, 3), ("absent", 0.1, 5)], blocks=8, shards=5)
    drawn = m.drawn().toPandas()
    report = m.report().toPandas().set_index("source")
    assert drawn.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict() == {"big": 1, "small": 3}
    assert not drawn.duplicated(["source", "doc_id", "pass"]).any()
    assert abs(report.loc["big", "tokens"] - 0.5 * m.total) <= 12 and report.loc["small", "tokens"] == 3 * report.loc["small", "available"]
    assert report.loc["absent", "tokens"] == 0 and report.loc["absent", "share_of_mix"] == 0
    assert report["tokens"].sum() == drawn["tokens"].sum() and abs(report["share_of_mix"].sum() - 1) < 1e-9
    for _, shard in drawn.groupby("shard"):
        assert sorted(shard["place"]) == list(range(1, len(shard) + 1))
    assert set(drawn["shard"]) <= set(range(5)) and drawn["shard"].nunique() == 5
    assert drawn.sort_values(["shard", "place"])["doc_id"].tolist() != sorted(drawn["doc_id"])


def test_nothing_and_nulls(spark, at):
    targets = [("a", 1.0, 1), (None, 0.5, 1), ("b", None, 1), ("c", 0.5, None)]
    m = mixture(spark, f"{at}/1", [], targets)
    assert m.drawn().count() == 0 and m.report().count() == 3
    m = mixture(spark, f"{at}/2", [(1, "some words here", "a"), (1, "some words here", "A"), (2, "more", "c"), (None, "x y", "b")], targets)
    assert {(r["doc_id"], r["source"]) for r in m.drawn().collect()} == {(1, "a")}
    m = mixture(spark, f"{at}/3", [(1, "some", "a")], [])
    assert m.drawn().count() == 0 and m.report().count() == 0


def test_many_repeats_of_a_small_source(spark, at):
    docs = [(i, "word " * (1 + i % 7), "small" if i < 40 else "large") for i in range(2000)]
    mix = Mixture(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame([("small", 0.6, 1000), ("large", 0.4, 1)], TARGETS), at, blocks=64)
    quota = mix.quotas.set_index("source")["quota"]
    assert mix.quotas.set_index("source")["blocks"]["small"] < 64 and len(mix.plan) < 64 * 9 * 2
    rows = mix.drawn().toPandas()
    copies = rows[rows["source"] == "small"].groupby("doc_id").size()
    assert copies.max() - copies.min() <= 1 and copies.max() <= 1000
    sums = rows.groupby("source")["tokens"].sum()
    assert all(0 <= quota[s] - sums[s] <= 8 for s in ("small", "large"))
    assert len(rows) == len(rows.drop_duplicates(["doc_id", "pass"]))

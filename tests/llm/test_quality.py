import random

import numpy as np
import pytest

from tidemark.llm import gbt
from tidemark.llm.quality import SHAPES, STATISTICS, calibration_error, fit_shapes, held_out, shapes, statistics, statistics_of

COMMON = [("en", w) for w in "the of and to in that a is was for on it with as by not".split()] + [("fr", "le"), (None, "zz"), ("de", None)]
DOCS = "doc_id bigint, text string"


def stats(text, common=({"the", "of", "a"}, {"le"})):
    return dict(zip(STATISTICS, statistics_of(text, [set(x) for x in common])))


def brute(text, common):
    """The five named statistics by plain loops."""
    words, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            words.append(run)
            run = ""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    symbols = sum(not (c.isalnum() or c.isspace()) for c in text)
    return {
        "words": len(text.split()),
        "mean_word_length": sum(map(len, words)) / max(1, len(words)),
        "symbol_ratio": symbols / max(1, len(text)),
        "line_end_punctuation": sum(x[-1] in ".!?:;”\"" for x in lines) / max(1, len(lines)),
        "common_words": max(sum(w in known for w in words) for known in common) / max(1, len(words)),
    }


def test_statistics_against_plain_loops():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abc the of le \n\t.,;:!?#$|-123éÜß ") for _ in range(rng.randrange(1, 200)))
        got, want = stats(text), brute(text, [{"the", "of", "a"}, {"le"}])
        if text.strip():
            assert {k: pytest.approx(got[k], abs=1e-9) for k in want} == want


def test_texts_without_words():
    assert set(stats("").values()) == {0.0} and set(stats(" \n\t ").values()) == {0.0}
    assert all(np.isfinite(list(stats(x).values())).all() for x in ("...", "7", "█" * 50, "x" * 200_000, "a\n" * 100_000))


def test_boosted_trees_learn_and_keep_what_they_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = gbt.fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    assert (gbt.fit(x[:2000], y[:2000]).margin(x) == model.margin(x)).all()
    assert len(model.margin(x[:0])) == 0
    constant = gbt.fit(np.zeros((10, 2)), np.ones(10))
    assert (constant.margin(np.zeros((3, 2))) > 0).all()


def test_calibration():
    rng = np.random.default_rng(2)
    z = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = gbt.platt(z, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1
    assert np.isfinite(gbt.platt(np.ones(5), np.ones(5))).all()


def corpus(rng, n):
    docs, truth = [], {}
    for i in range(n):
        kind = SHAPES[i % 4]
        name = lambda: rng.choice(["Orvel", "Kamind", "Taskar", "Beno", "Lirath", "Quess", "Marden"]) + rng.choice(["by", "wick", "dal", "orn", "eth", "is"])
        if kind == "prose":
            text = "\n".join(f"[{k}] " + " ".join(rng.choice(["the", "of", "and", "to", "in", "carrier", "pledge", "was", "held", "barley", name()]) for _ in range(rng.randrange(15, 60))) + "." for k in range(1, rng.randrange(3, 12)))
        elif kind == "list":
            text = "\n".join(f"({chr(97 + k % 26)}) {rng.choice(['copper wire', 'barley', 'wool bales'])}; {name()} {k}" for k in range(rng.randrange(8, 40)))
        elif kind == "table":
            text = "Item|Date|Sum\n" + "\n".join(f"{name()} | {rng.randrange(28)}.01.2011 | {rng.random() * 999:.2f} | {rng.randrange(999)}" for _ in range(rng.randrange(8, 40)))
        else:
            text = "\n".join("".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(76)) for _ in range(rng.randrange(5, 20)))
        docs.append((i, text))
        truth[i] = kind
    return docs, truth


def test_shapes_on_held_out_documents(spark, at):
    docs, truth = corpus(random.Random(4), 400)
    labels = [(i, "ann", truth[i] if i % 19 else "junk") for i in range(0, 200, 2)] + [(0, "b", "list"), (0, "c", "prose"), (7, "a", "odd"), (None, "a", "list")]
    documents = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, " \n ")], DOCS).selectExpr("*", "'x' as shape", "1 as words")
    got = shapes(documents, spark.createDataFrame(COMMON, "lang string, word string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, shape string"), at)
    rows = {r["doc_id"]: r["shape"] for r in got.collect()}
    assert len(rows) == 403 and all(rows[i] == "junk" for i in (5000, 5001, 5002))
    assert np.mean([rows[i] == truth[i] for i in range(200, 400)]) > 0.97


def test_shapes_of_nothing_and_without_labels(spark, at):
    none = spark.createDataFrame([], "doc_id bigint, annotator string, shape string")
    words = spark.createDataFrame([], "lang string, word string")
    assert shapes(spark.createDataFrame([], DOCS), words, none, f"{at}/1").count() == 0
    docs, truth = corpus(random.Random(6), 40)
    rows = shapes(spark.createDataFrame(docs * 2, DOCS), spark.createDataFrame(COMMON, "lang string, word string"), none, f"{at}/2").collect()
    assert len(rows) == 80 and np.mean([r["shape"] == truth[r["doc_id"]] for r in rows]) > 0.9


def test_a_shape_that_does_not_occur(spark, at):
    docs, truth = corpus(random.Random(8), 200)
    docs = [d for d in docs if truth[d[0]] != "table"]
    labels = spark.createDataFrame([(i, "a", truth[i]) for i, _ in docs[:9]], "doc_id bigint, annotator string, shape string")
    rows = shapes(spark.createDataFrame(docs, DOCS), spark.createDataFrame(COMMON, "lang string, word string"), labels, at).collect()
    assert np.mean([r["shape"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_hand_labels_kept_back_and_not_fitted_on(spark, at):
    docs, truth = corpus(random.Random(9), 300)
    labels = spark.createDataFrame([(i, "a", truth[i]) for i in range(300) if i % 3], "doc_id bigint, annotator string, shape string")
    documents, words = spark.createDataFrame(docs, DOCS), spark.createDataFrame(COMMON, "lang string, word string")
    rows = {r["shape"]: r for r in held_out(documents, words, labels, f"{at}/1").collect()}
    assert sum(r["labelled"] for r in rows.values()) < 150 and len(rows) == 4 and all(r["precision"] > 0.9 and r["recall"] > 0.9 and r["calibration_error"] < 0.3 for r in rows.values())
    all_labelled = spark.createDataFrame([(i, "a", s) for i, s in truth.items()], "doc_id bigint, annotator string, shape string")
    stats = statistics(documents, words)
    assert all(b.cuts == [] for b in fit_shapes(stats, all_labelled).boosters)
    few = fit_shapes(stats, labels, per_shape=40)
    assert all(b.cuts for b in few.boosters)
    assert calibration_error(np.array([0.2] * 10), np.array([1, 1] + [0] * 8)) == pytest.approx(0) and calibration_error(np.zeros(0), np.zeros(0)) == 0


def test_common_words_are_bounded(spark):
    many = spark.range(100_001).selectExpr("'en' as lang", "cast(id as string) as word")
    with pytest.raises(ValueError, match="100,000"):
        statistics(spark.createDataFrame([], DOCS), many)

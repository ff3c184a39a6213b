"""Statistics of each document's text, and from them whether it is prose, a list, a table or junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import gbt

SHAPES = ["prose", "list", "table", "junk"]
STATISTICS = [
    "words", "mean_word_length", "symbol_ratio", "line_end_punctuation", "common_words",
    "digits", "capitals", "titled", "strange", "words_a_line", "longest_words", "vowels", "distinct_words", "repeated_lines",
    "short_lines", "field_lines", "fields_a_line", "numeric_fields", "even_fields", "marked_lines", "same_opening", "sentence_words", "lower_starts", "spaces",
]
_WORD = re.compile(r"[^\W\d_]+")
_FIELDS = re.compile(r"\s*[|;\t]\s*|\s{2,}|,(?=\S)|\s(?:>|::)\s")
_NUMERIC = re.compile(r"[\d.,:/%€$£-]*\d[\d.,:/%€$£-]*")
_MARK = re.compile(r"(?:[-*•–·]|\(?\w{1,4}[.):]|\[?\d{1,4}[\]:.)]?|\w+ \d{1,4}:)\s*\S")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_USUAL = re.compile(r"[\w\s.,;:!?'\"()\[\]/&%§¶|=+*#@<>_-]+")


def statistics_of(text: str, common: list[set[str]]) -> list[float]:
    """STATISTICS of a text, over all of it; zeros for one without words or lines. ``common``: the common words of each language, of which the language with most counts."""
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    size = len(text)
    if not lines:
        return [0.0] * len(STATISTICS)
    tokens, words = text.split(), _WORD.findall(text.lower())
    n, m, k = max(1, len(words)), max(1, len(tokens)), len(lines)
    letters = sum(map(len, words))
    seen = Counter(words)
    shares = [sum(c for w, c in seen.items() if w in known) / n for known in common]
    digits = len(re.findall(r"\d", text))
    blank = len(re.findall(r"\s", text))
    joined = "".join(words)
    vowels = sum(map(joined.count, "aeiouyäöüéèêàâîôûæøå"))
    usual = sum(len(x) for x in _USUAL.findall(text))
    fields = [_FIELDS.split(x) for x in lines]
    counts = [len(x) for x in fields]
    with_fields = [f for f in fields if len(f) >= 3]
    cells = sum(map(len, with_fields))
    numeric = sum(1 for f in with_fields for x in f if _NUMERIC.fullmatch(x))
    usual_count = Counter(c for c in counts if c >= 3).most_common(1)
    openings = Counter((re.sub(r"\d+", "0", x)[:3] if x[0].isalnum() else x[0]) for x in lines)
    ended, sentence = 0, 0
    for x in lines:
        if x[-1] in ".!?:;”\"":
            ended += 1
        if len(x) > 60 or _SENTENCE.search(x):
            sentence += x.count(" ") + 1
    return [
        float(len(tokens)), letters / n, (size - letters - digits - blank) / size, ended / k, max(shares, default=0.0),
        digits / size, sum(1 for x in tokens if x.isupper()) / m, sum(1 for x in tokens if x[0].isupper()) / m, 1 - usual / size, m / k, sum(1 for x in tokens if len(x) > 25) / m,
        vowels / max(1, letters), len(seen) / n, 1 - len(set(lines)) / k,
        sum(1 for x in lines if x.count(" ") < 9) / k, len(with_fields) / k, cells / max(1, len(with_fields)), numeric / max(1, cells),
        (usual_count[0][1] / k if usual_count else 0.0), sum(1 for x in lines if _MARK.match(x)) / k, openings.most_common(1)[0][1] / k, min(1.0, sentence / m), sum(1 for x in lines if x[0].islower()) / k, blank / size,
    ]


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS) of every document, over its whole text, without a shuffle. A null text counts as an empty one.

    The share of common words is that of the language whose words it has most of: ``lang`` is not to be relied on.
    common_words is a fixed list, which is broadcast; one of over 100,000 words is refused.
    """
    listed = common_words.where("word is not null").select("lang", F.lower("word").alias("word")).limit(100_001).collect()
    if len(listed) > 100_000:
        raise ValueError("common_words has over 100,000 words")
    by_lang: dict[str, set[str]] = {}
    for row in listed:
        by_lang.setdefault(row["lang"] or "", set()).add(row["word"])
    common = documents.sparkSession.sparkContext.broadcast([by_lang[x] for x in sorted(by_lang)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(t.as_py() or "", common.value) for t in batch.column("text")], float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *[pa.array(rows[:, j]) for j in range(len(STATISTICS))]], ["doc_id", *STATISTICS])

    return documents.select("doc_id", "text").mapInArrow(measure, "doc_id bigint, " + ", ".join(f"{x} double" for x in STATISTICS))


def weak_label() -> Column:
    """A shape by plain rules, for sure cases only; null for the others, which are about a quarter. The trees learn from these."""
    c = F.col
    return (
        F.when(c("words") == 0, "junk")
        .when((c("even_fields") > 0.75) & (c("numeric_fields") > 0.65) & (c("common_words") < 0.3), "table")
        .when((c("common_words") > 0.36) & (c("sentence_words") > 0.8) & (c("field_lines") < 0.35) & (c("strange") < 0.01), "prose")
        .when((c("strange") > 0.15) | ((c("longest_words") > 0.5) & (c("field_lines") < 0.5)) | ((c("symbol_ratio") > 0.3) & (c("digits") < 0.15)), "junk")
        .when((c("mean_word_length") < 2.2) | ((c("distinct_words") < 0.12) & (c("digits") < 0.08)), "junk")
        .when((c("distinct_words") < 0.2) & (c("digits") < 0.01) & (c("marked_lines") < 0.2), "junk")
        .when((c("common_words") < 0.04) & (c("titled") < 0.15) & (c("marked_lines") < 0.2) & (c("digits") < 0.1) & (c("field_lines") < 0.5), "junk")
        .when((c("marked_lines") > 0.75) & (c("words_a_line") < 12) & (c("sentence_words") < 0.3) & (c("common_words") < 0.12), "list")
        .when((c("words_a_line") < 5.5) & (c("titled") > 0.7) & (c("distinct_words") > 0.45) & (c("sentence_words") < 0.3) & (c("numeric_fields") < 0.3), "list")
    )


@dataclass
class ShapeModel:
    """One booster a shape, the calibration of its margins, and what the hand labels kept back for it say: (shape, labelled, precision, recall, calibration_error)."""

    boosters: list[gbt.Booster]
    calibration: list[tuple[float, float]]
    checked: list[tuple[str, int, float | None, float | None, float | None]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(a * b.margin(x) + c, -30, 30))) for b, (a, c) in zip(self.boosters, self.calibration)]
        p = np.stack(out, axis=1)
        return p / p.sum(axis=1, keepdims=True)


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """The mean distance of stated from actual shares over bins of what is stated, weighted by rows."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[at == k].sum() - y[at == k].sum()) for k in range(bins)) / max(1, len(p)))


def fit_shapes(stats: DataFrame, doc_labels: DataFrame, per_shape: int = 3000, checked: int = 5000, rounds: int = 40) -> ShapeModel:
    """Boosted trees fitted on at most ``per_shape`` weakly labelled documents of each shape, calibrated on hand-labelled ones, of which at most ``checked`` are used.

    Both samples are the documents with the least hashes of their ids, so the bound holds at every size; those of a shape are found by a threshold on the
    hash from its count, so no task sorts a shape. Documents with a hand label are not fitted on. The hand labels are cut in two by hash: one half
    calibrates, the other is kept back for ``ShapeModel.checked``. Of several labels of a document the commonest counts, ties by
    name. A shape without weak labels is never predicted; without hand labels the margins stay as they are.
    """
    hashed = F.xxhash64("doc_id")
    weak = stats.withColumn("shape", weak_label()).where("shape is not null")
    counts = {r["shape"]: r["count"] for r in weak.groupBy("shape").count().collect()}  # four rows
    share = F.coalesce(*[F.when(F.col("shape") == s, F.lit(min(1.0, 1.1 * per_shape / n))) for s, n in counts.items()], F.lit(0.0))
    few = weak.withColumn("h", hashed).where(F.pmod("h", F.lit(1 << 32)) < share * float(1 << 32)).select("doc_id", "shape", "h", *STATISTICS)
    rows = few.join(doc_labels.select("doc_id").distinct(), "doc_id", "left_anti").toPandas()
    rows = rows.assign(h=rows["h"].to_numpy(np.int64) % (1 << 32)).sort_values(["shape", "h", "doc_id"]).groupby("shape").head(per_shape)
    x, y = rows[STATISTICS].to_numpy(float), rows["shape"].to_numpy()
    boosters = [gbt.fit(x, (y == s).astype(float), rounds) if (y == s).any() else gbt.Booster([], [], [], [], -30.0) for s in SHAPES]
    votes = doc_labels.where(F.col("shape").isin(SHAPES)).groupBy("doc_id", "shape").count()
    settled = votes.groupBy("doc_id").agg(F.min_by("shape", F.struct(-F.col("count"), F.col("shape"))).alias("shape"))
    least = settled.orderBy(hashed, "doc_id").limit(checked)
    held = stats.join(F.broadcast(least), "doc_id").dropDuplicates(["doc_id"]).select("shape", hashed.alias("h"), *STATISTICS).orderBy("h").toPandas()
    hx, hy, tuned = held[STATISTICS].to_numpy(float), held["shape"].to_numpy(), held["h"].to_numpy(np.int64) // 2 % 2 == 0
    calibration = [gbt.platt(b.margin(hx[tuned]), (hy[tuned] == s).astype(float)) if tuned.any() and b.cuts else (1.0, 0.0) for b, s in zip(boosters, SHAPES)]
    model = ShapeModel(boosters, calibration, [])
    kept = hx[~tuned]
    p = model.probabilities(kept) if len(kept) else np.zeros((0, len(SHAPES)))
    best, truth = p.argmax(axis=1) if len(kept) else np.zeros(0, int), hy[~tuned]
    for k, s in enumerate(SHAPES):
        right, found, there = int(((best == k) & (truth == s)).sum()), int((best == k).sum()), int((truth == s).sum())
        model.checked.append((s, there, right / found if found else None, right / there if there else None, calibration_error(p[:, k], truth == s) if len(kept) else None))
    return model


def shapes(documents: DataFrame, common_words: DataFrame, doc_labels: DataFrame, path: str) -> DataFrame:
    """(doc_id, STATISTICS, shape, probability) of every document; the statistics are kept at ``path``.

    The text is read once; fitting and scoring read the stored statistics. A text without words is junk.
    """
    stats = stored(statistics(documents, common_words), f"{path}/statistics")
    model = documents.sparkSession.sparkContext.broadcast(fit_shapes(stats, doc_labels))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = model.value.probabilities(frame[STATISTICS].to_numpy(float))
            best = p.argmax(axis=1) if len(frame) else np.zeros(0, int)
            best[frame["words"].to_numpy() == 0] = SHAPES.index("junk")
            yield frame.assign(shape=[SHAPES[i] for i in best], probability=p[np.arange(len(frame)), best])

    return stats.mapInPandas(score, "doc_id bigint, " + ", ".join(f"{x} double" for x in STATISTICS) + ", shape string, probability double")


def held_out(documents: DataFrame, common_words: DataFrame, doc_labels: DataFrame, path: str) -> DataFrame:
    """(shape, labelled, precision, recall, calibration_error, trees_decide) of each shape that hand labels kept back have; ``trees_decide`` is the share of all documents without a weak label."""
    stats = stored(statistics(documents, common_words), f"{path}/statistics")
    model = fit_shapes(stats, doc_labels)
    rows = documents.sparkSession.createDataFrame(model.checked, "shape string, labelled bigint, precision double, recall double, calibration_error double")
    share = stats.agg(F.avg(weak_label().isNull().cast("double")).alias("trees_decide"))
    return rows.where("labelled > 0").join(F.broadcast(share))  # one row

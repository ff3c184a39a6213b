import random
import time

import numpy as np
import pytest

from tidemark.llm.leaks import Limits, build_index, chained, distance, find_leaks, hashes, scanned, seeds_of, squeezed

WORDS = "carrier tenant pledge covenant harbour invoice survey receiver warehouse barley timber towpath easement registrar charter deposit schedule exhibit guarantee insurer".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "ly"]) + (f" {rng.randrange(99)}" if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


def test_squeezed_leaves_letters_and_digits():
    assert squeezed("Él sur-\nveyor,  É. ***  12 km²") == "elsurveyore12km2"
    assert squeezed("") == "" and squeezed("日本 □ ы́.") == "日本ы" and squeezed("Straße") == "strasse"


@pytest.mark.parametrize("q", [1, 2, 3, 7, 12, 16, 31])
def test_equal_grams_have_equal_hashes(q):
    rng = np.random.default_rng(q)
    codes = rng.integers(97, 100, 400).astype(np.uint8)
    h, text = hashes(codes, q), codes.tobytes()
    grams = [text[i : i + q] for i in range(len(text) - q + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
    first = {}
    for g, x in zip(grams, h.tolist()):
        assert first.setdefault(g, x) == x
    assert len(hashes(codes[: q - 1], q)) == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment_against_the_whole_table(rng):
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(25)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("abc") for _ in range(rng.randrange(2))]
        want = edits(a, "".join(b))
        for budget in range(8):
            assert distance(a, "".join(b), budget) == (want if want <= budget else None)


def test_the_budget_leaves_a_gram():
    limits, n = Limits(), np.arange(8, 3000)
    assert (limits.grams(n) >= 1).all() and (limits.budget(n) <= limits.edits * n + 1e-9).all()
    assert (limits.budget(n[n >= 40]) == np.floor(limits.edits * n[n >= 40] + 1e-9)).all()


def test_chain_keeps_the_order_of_the_item():
    assert chained([(50, 90, 0, 40), (0, 60, 100, 160)]) == [(0, 60, 100, 160)]
    assert chained([(0, 40, 0, 40), (35, 80, 200, 245), (70, 90, 100, 120)]) == [(0, 40, 0, 40), (35, 80, 200, 245)]
    assert chained([]) == []


def test_chain_against_all_subsets(rng):
    def covered(chain):
        total, end = 0, 0
        for p, q, _, _ in chain:
            total, end = total + max(0, q - max(p, end)), max(end, q)
        return total

    def fits(chain):
        return all(a[0] <= b[0] and a[2] <= b[2] for a, b in zip(chain, chain[1:]))

    for _ in range(200):
        found = [(p, p + rng.randrange(1, 9), s, s + 5) for p, s in ((rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(1, 8)))]
        ordered = sorted(set(found))
        chains = ([x for i, x in enumerate(ordered) if mask >> i & 1] for mask in range(1 << len(ordered)))
        got = chained(found)
        assert fits(got) and covered(got) == max(covered(c) for c in chains if fits(c))


def test_many_passages_are_chained_soon(rng):
    found = [(p, p + 40, s, s + 40) for p, s in ((rng.randrange(600), rng.randrange(10**7)) for _ in range(20_000))]
    began = time.process_time()
    assert len(chained(found)) > 10 and time.process_time() - began < 20


def shares(index, text):
    return {item: len(words) / index.sizes[index.ids.index(item)] for item, words in scanned(text, index)[1]}


def test_copies_that_differ_in_what_does_not_matter(rng):
    item = prose(rng, 120)
    index = build_index([(1, item), (2, prose(rng, 120))], Limits())
    words = item.split()
    wrapped = "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(words))
    hyphened = " ".join(w[:3] + "-\n" + w[3:] if i % 11 == 5 and len(w) > 5 else w for i, w in enumerate(words))
    paged = " ".join([*words[:60], "\n[Page 7 / RSC 12/1990]\n", *words[60:]])
    blacked = " ".join("█████" if i % 17 == 8 else w for i, w in enumerate(words))
    altered = " ".join(w.replace("r", "n") if i % 13 == 6 else w for i, w in enumerate(words))
    for text in (item, item.upper(), wrapped, hyphened, paged, blacked, altered):
        got = shares(index, prose(rng, 300) + "\n" + text + "\n" + prose(rng, 300))
        assert got.get(1, 0) > 0.8 and got.get(2, 0) < 0.2


def test_part_copies_and_scattered_phrases(rng):
    item = prose(rng, 120)
    index, words = build_index([(1, item)], Limits()), item.split()
    two = prose(rng, 50) + " ".join(words[10:40]) + prose(rng, 200) + " ".join(words[70:100]) + prose(rng, 50)
    assert 0.45 < shares(index, two)[1] < 0.55
    turned = prose(rng, 50) + " ".join(words[70:100]) + prose(rng, 200) + " ".join(words[10:40]) + prose(rng, 50)
    assert shares(index, turned)[1] < 0.3
    scattered = " ".join(" ".join(words[i : i + 3]) + " " + prose(rng, 6) for i in range(0, 120, 3))
    assert shares(index, scattered).get(1, 0) < index.limits.share
    assert shares(index, "") == {} and shares(index, "short") == {}


def test_very_long_text(rng):
    item = prose(rng, 100)
    index = build_index([(1, item)], Limits())
    filler = prose(random.Random(1), 5000)
    assert shares(index, filler * 60 + item + filler)[1] > 0.9


def found(spark, at, docs, items, **limits):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as item_id", "'y' as words")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'z' as doc_id")
    return sorted(((r["item_id"], r["doc_id"]) for r in find_leaks(documents, bench, at, Limits(**limits)).collect()), key=str)


def test_operator_with_nulls_repeats_and_nothing(spark, at, rng):
    a, b = prose(rng, 100), prose(rng, 90)
    docs = [(1, f"{prose(rng, 40)} {a}"), (1, f"{prose(rng, 40)} {a}"), (2, None), (3, ""), (4, prose(rng, 400)), (5, f"{a} {b}"), (None, b)]
    items = [(1, a), (2, b), (3, b), (4, None), (5, ""), (6, "too short"), (None, a), (7, prose(rng, 80)), (7, b)]
    want = [(1, 1), (1, 5), (2, 5), (2, None), (3, 5), (3, None), (7, 5), (7, None)]
    assert found(spark, f"{at}/1", docs, items) == want
    assert found(spark, f"{at}/2", [], items) == [] and found(spark, f"{at}/3", docs, []) == []


def test_items_in_turns_give_the_same(spark, at, rng):
    texts = [prose(rng, 100) for _ in range(5)]
    documents = spark.createDataFrame([(i, prose(rng, 30) + " " + t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = find_leaks(documents, bench, at, most_letters=1500).collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in rows) == [(i, i) for i in range(5)]


def test_stock_phrases_do_not_count(spark, at, rng):
    stock, own = prose(rng, 45), prose(rng, 55)
    docs = [(i, f"{prose(rng, 60)} {stock} {prose(rng, 60)}") for i in range(70)] + [(100, f"{prose(rng, 60)} {own}")]
    assert found(spark, at, docs, [(1, f"{stock} {own}")]) == [(1, 100)]


@pytest.mark.parametrize("equal", [1, 4, 20])
def test_equal_items_in_any_number(spark, at, rng, equal):
    item = prose(rng, 80)
    items = [(i, item) for i in range(equal)] + [(i, f"{item} {i}") for i in range(100, 100 + equal)]
    docs = [(1, f"{prose(rng, 60)} {item} {prose(rng, 60)}"), (2, prose(rng, 90))]
    assert found(spark, at, docs, items) == sorted([(i, 1) for i, _ in items], key=str)


def test_short_items(rng):
    items = ["barley covenant ledger", "a cat", "insurer", "the seventh towpath", "harbour by barge at noon", "Он ест"]
    index = build_index(list(enumerate(items)), Limits())
    for i, item in enumerate(items):
        for text in (item, f"{prose(rng, 80)} {item.upper()}. {prose(rng, 80)}", f"{prose(rng, 40)}\n  {item.replace(' ', chr(10))}, {prose(rng, 40)}"):
            got = shares(index, text)
            assert got.pop(i, 0) == 1 and (not got or i == 2 or set(got) == {2})
    assert shares(index, "a catalogue of ledgers; the seventh bowpath") == {}
    assert shares(build_index([(1, "alpha bravo charlie delta echo foxtrot")], Limits()), "x " + "charlie delta echo" + " y") == {1: 0.5}


def test_items_of_any_script(spark, at, rng):
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 11))) for _ in range(4000)]
    russian = " ".join(rng.choice(words) for _ in range(70))
    other = " ".join(rng.choice(words) for _ in range(300))
    greek = "".join(chr(rng.randrange(0x3B1, 0x3C9)) if rng.random() < 0.8 else " " for _ in range(400))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(120))
    docs = [(1, f"{other[:700]} {russian.upper()} {other[700:]}"), (2, other), (3, prose(rng, 50) + greek + prose(rng, 50)), (4, f"{chinese}"), (5, f"{prose(rng, 100)} {' '.join(russian.split()[10:45])}")]
    assert found(spark, at, docs, [(1, russian), (2, greek), (3, chinese), (4, prose(rng, 90))]) == [(1, 1), (1, 5), (2, 3), (3, 4)]


@pytest.mark.parametrize("rate, least", [(0, 1), (0.04, 0.98), (0.08, 0.9)])
def test_recall_within_the_budget(rng, rate, least):
    items = [prose(rng, 100) for _ in range(60)]
    index, hit = build_index(list(enumerate(items)), Limits()), 0
    for i, item in enumerate(items):
        copy = "".join("" if x < rate / 3 else rng.choice("abcdefgh") + c if x < 2 * rate / 3 else rng.choice("abcdefgh") if x < rate else c for c, x in ((c, rng.random() if c != " " else 1) for c in " ".join(item.split()[20:90])))
        hit += shares(index, f"{prose(rng, 90)} {copy} {prose(rng, 90)}").get(i, 0) >= index.limits.share
    assert hit >= least * len(items)


def test_equal_items_and_shared_passages(spark, at, rng):
    item, shared, phrase = prose(rng, 100), prose(rng, 60), prose(rng, 12)
    items = [(i, item) for i in range(5)] + [(i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for i in range(10, 15)]
    items += [(i, f"{prose(rng, 50)} {phrase} {prose(rng, 60)}") for i in range(20, 26)]
    part = " ".join(items[-1][1].split()[32:90])
    docs = [(1, f"{prose(rng, 60)} {item} {prose(rng, 60)}"), (2, f"{prose(rng, 60)} {shared} {prose(rng, 60)}"), (3, f"{prose(rng, 60)} {part} {prose(rng, 60)}")]
    assert found(spark, at, docs, items) == sorted([*[(i, 1) for i in range(5)], *[(i, 2) for i in range(10, 15)], (25, 3)], key=str)


def test_phrases_of_many_items_count_in_a_copy(rng):
    phrases = [prose(rng, 9) for _ in range(6)]
    texts = [" ".join(f"{prose(rng, 10)} {p}" for p in phrases) for _ in range(6)]
    index, words = build_index(list(enumerate(texts)), Limits()), texts[0].split()
    n = -(-2 * len(words) // 5)
    for start in range(0, len(words) - n + 1, 3):
        got = shares(index, f"{prose(rng, 80)} {' '.join(words[start : start + n])} {prose(rng, 80)}")
        assert got.pop(0) >= index.limits.share and all(x < index.limits.share for x in got.values())


def test_every_stretch_has_seeds(rng):
    limits, shared = Limits(), np.array([rng.choice([1, 9, 9, 9, 9, 9]) for _ in range(300)] + [7] * 300)
    seed, width = seeds_of(shared, limits), int(limits.share / 2 * 600)
    assert seed[shared == 1].all() and min(seed[i : i + width].sum() for i in range(600 - width + 1)) >= limits.seeds
    assert seeds_of(np.full(20, 9), limits).all() and len(seeds_of(np.zeros(0, int), limits)) == 0


@pytest.mark.parametrize("by", ["docket", "copies"])
def test_a_third_of_all_rows_is_one_context(spark, at, rng, by):
    item = prose(rng, 100)
    part, copy = " ".join(item.split()[20:65]), f"{prose(rng, 60)} {item} {prose(rng, 60)}"
    quoting = [(i, f"{prose(rng, 60)} {part} {prose(rng, 60)}" if by == "docket" else copy.replace("harbour", "haven", i % 3), "17-1" if by == "docket" else None) for i in range(80)]
    docs = [*quoting, (500, f"{prose(rng, 60)} {part} {prose(rng, 60)}", "9-1"), *((i, prose(rng, 150), None) for i in range(1000, 1160))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, docket_no string")
    rows = find_leaks(documents, spark.createDataFrame([(1, item)], "item_id bigint, text string"), at).collect()
    assert sorted(r["doc_id"] for r in rows) == [*range(80), 500]


def test_stock_is_a_share_at_every_size(spark, at, rng):
    stock, own = prose(rng, 45), prose(rng, 55)
    docs = [(i, f"{prose(rng, 60)} {stock} {prose(rng, 60)}") for i in range(40)] + [(i, prose(rng, 120)) for i in range(50, 100)] + [(100, f"{stock} {own}")]
    assert found(spark, at, docs, [(1, f"{stock} {own}")]) == [(1, 100)]

"""Held-out passages inside a corpus, by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Characters hashed at a time, so that memory does not depend on how long a text is.
BLOCK = 1 << 20
_KEPT = bytes(range(48, 58)) + bytes(range(97, 123))
_DROPPED = bytes(sorted(set(range(256)) - set(_KEPT)))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LETTER_BEYOND_ASCII = re.compile(r"[^\W\x00-\x7f]")
_NOT_A_LETTER = re.compile(r"[\W_]+")
#: Bits of a hash that the bit table is asked by.
_TABLE = 22


@dataclass(frozen=True)
class Limits:
    """What counts as a copied passage. Lengths are in letters and digits, all that is left of a text."""

    q: int = 8
    #: The budget of edits in a passage as a share of its length, of the filter and of the alignment alike; see budget.
    edits: float = 0.08
    #: Least length of a passage. Of a shorter item, or one whose share is shorter, it is that share, at least two q-grams' length, at most the item.
    length: int = 40
    #: Width of a diagonal band, and how far apart in the item two neighbouring q-grams of a region may lie. A region that does not meet
    #: the bound is cut where they lie further apart than ``tight`` and asked again.
    band: int = 48
    gap: int = 48
    tight: int = 16
    #: A q-gram in at most this many texts of items is a seed, and where a stretch of an item half as long as its share has fewer
    #: than ``seeds`` of them, its rarest ones are too. An item is looked for, by all its q-grams, in a text that has the part of the seeds of two
    #: such stretches that the lemma leaves (1 - q * edits), four of them in one band. An item shorter than two passages needs one.
    items: int = 3
    seeds: int = 32
    #: Share of an item's words that a document must repeat.
    share: float = 0.4
    #: Words of an item in copied passages of more than this share of all contexts, by three standard deviations of it, are stock phrases.
    #: A context is a docket, or the texts without one that are nearly equal; counted by text alone, whatever the docket, it must be so too.
    stock: float = 0.2

    def budget(self, length):
        """Edits that a passage of a length may need: the share, but never more than leave it a q-gram by the lemma."""
        return np.maximum(0, np.minimum((self.edits * length + 1e-9) // 1, length // self.q - 1)).astype(int)

    def grams(self, length):
        """The q-gram lemma: shared q-grams that a passage within its budget has at least, in the band of its budget."""
        return length - self.q + 1 - self.budget(length) * self.q

    def least(self, size: int) -> int:
        """Least length of a passage of an item of so many letters."""
        return min(size, self.length, max(2 * self.q, int(np.ceil(self.share * size))))


def squeezed(text: str) -> str:
    """Letters and digits of a text of any script, in lower case without accents: case, layout, hyphens and page breaks are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        if _LETTER_BEYOND_ASCII.search(text):
            return _NOT_A_LETTER.sub("", text)
        return text.encode("ascii", "ignore").translate(None, _DROPPED).decode()
    return text.lower().encode().translate(None, _DROPPED).decode()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, in about log2(q) vector operations."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    power, width, done, part = _MULTIPLIER, 1, 0, codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                out = out * power + part[done : done + n]
                done += width
            if width * 2 > q:
                break
            part = part[:-width] * power + part[width:]
            power, width = power * power, width * 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass
class Index:
    """The q-grams of all texts of items: sorted hashes, the seeds by hash, all places by text, and a bit table asked first."""

    ids: list[int]
    texts: list[str]
    #: Per text, the word to which each character belongs.
    words: list[np.ndarray]
    limits: Limits
    sizes: list[int] = field(init=False)
    #: Per text, the least length of its passages, and how many seeds another text must have, and in one band, to be looked into.
    least: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    in_band: np.ndarray = field(init=False)
    #: Per text, the least that the lemma asks for, of a passage of any length.
    fewest: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)
    seed_start: np.ndarray = field(init=False)
    seed_item: np.ndarray = field(init=False)
    seed_place: np.ndarray = field(init=False)
    #: Per text: the key of each of its places in turn, and whether that is a seed.
    own: list[tuple[np.ndarray, np.ndarray]] = field(init=False)
    #: Zero for each key, but for those of the text that ``places`` is looking up.
    slot: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    depth: int = field(init=False)
    #: Texts too short for a q-gram, by their words.
    tiny: dict[tuple[str, ...], list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        limits = self.limits
        self.least = np.array([limits.least(len(t)) for t in self.texts], int)
        self.sizes = [int(w[-1]) + 1 if len(w) else 0 for w in self.words]
        each = [hashes(codes_of(t), limits.q) for t in self.texts]
        h = np.concatenate([*each, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(each)), [len(x) for x in each]).astype(np.int32)
        place = np.concatenate([*[np.arange(len(x)) for x in each], np.zeros(0, int)]).astype(np.int32)
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        new_item = first | np.r_[True, item[1:] != item[:-1]] if len(h) else first
        shared = np.bincount(group, new_item)[group].astype(int) if len(h) else group
        seed = np.zeros(len(h), bool)
        by_place = np.lexsort((place, item))
        ends = np.cumsum([len(x) for x in each])[:-1]
        for own in np.split(by_place, ends):
            seed[own] = seeds_of(shared[own], limits)
        self.keys, start = np.unique(h, return_index=True)
        self.seed_item, self.seed_place = item[seed], place[seed]
        self.seed_start = np.r_[0, np.cumsum(seed)][np.r_[start, len(h)]]
        self.own = [(group[own].astype(np.int32), seed[own]) for own in np.split(by_place, ends)]
        # A passage of the least length may have one q-gram left, where it is all that an item's share asks for.
        count = np.array([int(x[1].sum()) for x in self.own], int)
        self.start = np.where(self.least < limits.length, 1, np.clip(((1 - limits.q * limits.edits) * np.minimum(2 * limits.seeds, limits.share * count)).astype(int), 1, None))
        self.in_band = np.minimum(4, self.start)
        self.fewest = np.array([int(limits.grams(np.arange(x, 4 * x + 1)).min()) for x in self.least], int)
        self.slot = np.zeros(len(self.keys), np.int32)
        bucket = (self.keys >> np.uint64(64 - _TABLE)).astype(np.int64)
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[bucket] = True
        self.first = np.searchsorted(bucket, np.arange(1 << _TABLE)).astype(np.int32)
        self.depth = int(np.bincount(bucket).max()) if len(bucket) else 0

    def hits(self, h: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the key) of every q-gram that an item has too, from hashes that begin at a place."""
        bucket = (h >> np.uint64(64 - _TABLE)).astype(np.int64)
        at = np.flatnonzero(self.table[bucket])
        key, h = self.first[bucket[at]], h[at]
        open_ = np.flatnonzero(self.keys[key] != h)
        while len(open_):
            key[open_] += 1
            over = key[open_] >= len(self.keys)
            key[open_[over]] = -1
            open_ = open_[~over]
            open_ = open_[self.keys[key[open_]] < h[open_]]
        sure = self.keys[key] == h
        return at[sure] + start, key[sure]

    def seeded(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The items to be looked for: those with enough seeds, by place in the item, and enough in one of the overlapping diagonal bands."""
        spread, count = _ranges(self.seed_start[key], self.seed_start[key + 1])
        many = np.bincount(self.seed_item[spread], minlength=len(self.ids)) >= self.start
        kept = many[self.seed_item[spread]]
        seed, diagonal = spread[kept], (np.repeat(at, count) - self.seed_place[spread])[kept]
        # A seed that the text repeats is one.
        here = np.zeros(len(self.seed_item), bool)
        here[seed] = True
        many &= np.bincount(self.seed_item[np.flatnonzero(here)], minlength=len(self.ids)) >= self.start
        kept = many[self.seed_item[seed]]
        fine = np.sort((self.seed_item[seed[kept]].astype(np.int64) << 40) + (1 << 39) + diagonal[kept] // (self.limits.band // 2))
        if not len(fine):
            return fine
        # Two neighbouring halves are a band.
        first = np.flatnonzero(np.r_[True, fine[1:] != fine[:-1]])
        value, n = fine[first], np.diff(np.append(first, len(fine)))
        n[:-1] += np.where(value[1:] == value[:-1] + 1, n[1:], 0)
        owner = value >> 40
        return np.unique(owner[n >= self.in_band[owner]])

    def places(self, at: np.ndarray, key: np.ndarray, items: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the text, place in the item, whether that is a seed) of all hits of some items."""
        order = np.argsort(key)
        at, key = at[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.slot[key[first]] = np.arange(1, len(first) + 1)
        own = [self.own[i] for i in items]
        slot = self.slot[np.concatenate([x for x, _ in own])]
        self.slot[key[first]] = 0
        has = np.flatnonzero(slot)
        spread, count = _ranges(first[slot[has] - 1], np.append(first, len(key))[slot[has]])
        has = np.repeat(has, count)
        sizes = [len(x) for x, _ in own]
        starts = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(items)), sizes)[has]
        return np.array(items)[number], at[spread], has - starts[number], np.concatenate([x for _, x in own])[has]


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the length of each."""
    count = end - first
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum()), count


def seeds_of(shared: np.ndarray, limits: Limits) -> np.ndarray:
    """Which places of an item are seeds, from the number of texts that have the q-gram of each."""
    seed = shared <= limits.items
    width = min(len(seed), max(limits.seeds, int(limits.share / 2 * len(seed))))
    least, at = min(limits.seeds, width), 0
    while True:
        sums = np.r_[0, np.cumsum(seed)]
        poor = np.flatnonzero(sums[at + width :] - sums[at : len(sums) - width] < least)
        if not width or not len(poor):
            return seed
        at += int(poor[0])
        others = at + np.flatnonzero(~seed[at : at + width])
        # The last of equally rare ones, for the sake of the stretches that follow.
        order = np.lexsort((-others, shared[others]))
        seed[others[order[: least - (width - len(others))]]] = True


def build_index(items: list[tuple[int, str]], limits: Limits) -> Index:
    """An index of texts by number. The texts should be distinct: equal ones only cost time."""
    ids, texts, words, tiny = [], [], [], {}
    for item, text in items:
        parts = [p for p in (squeezed(w) for w in re.split(r"\s+", text or "")) if p]
        if 0 < sum(map(len, parts)) < limits.q:
            tiny.setdefault(tuple(parts), []).append(len(ids))
        ids.append(item)
        texts.append("".join(parts))
        words.append(np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int32))
    return Index(ids, texts, words, limits, tiny=tiny)


@dataclass
class Regions:
    """Stretches of hits of items: rows (item, place from, to, text from, to, first hit, last hit) by item, and the hits that they number."""

    rows: np.ndarray
    place: np.ndarray
    at: np.ndarray


def regions(item: np.ndarray, at: np.ndarray, place: np.ndarray, seed: np.ndarray, least: np.ndarray, fewest: np.ndarray, limits: Limits) -> Regions:
    """Stretches of overlapping diagonal bands with a seed and as many shared q-grams as the lemma asks for, of the least length of their item."""
    half = limits.band // 2
    diagonal = at - place.astype(np.int64)
    strip = diagonal // half
    if len(at):
        # Most hits lie in bands with too few of them.
        lowest = int(strip.min())
        width = int(strip.max()) - lowest + 3
        number = np.cumsum(np.r_[0, item[1:] != item[:-1]]) * width + strip - lowest + 1
        n = np.bincount(number, minlength=int(number[-1]) + width)
        kept = np.flatnonzero(n[number] + np.maximum(n[number - 1], n[number + 1]) >= fewest[item])
        item, at, place, seed, strip, diagonal = item[kept], at[kept], place[kept], seed[kept], strip[kept], diagonal[kept]
    if not len(at):
        return Regions(np.zeros((0, 7), int), place, at)
    inside = diagonal - strip * half
    # Every hit is in two bands: that beginning with its strip and that beginning with the strip before.
    owner, strip, inside = np.tile(item.astype(np.int64), 2), np.r_[strip, strip - 1], np.r_[inside, inside + half]
    lowest = int(strip.min())
    strip -= lowest
    p, s = np.tile(place.astype(np.int64), 2), np.tile(seed, 2)
    bits = [int(x).bit_length() for x in (strip.max(), p.max(), limits.band, 1)]
    if int(owner.max()).bit_length() + sum(bits) < 63:
        # Sorted as one number, much faster than by columns.
        packed = owner
        for value, n in zip((strip, p, inside, s), bits):
            packed = (packed << n) | value
        packed.sort()
        s, rest = (packed & 1).astype(bool), packed >> 1
        inside, rest = rest & ((1 << bits[2]) - 1), rest >> bits[2]
        p, rest = rest & ((1 << bits[1]) - 1), rest >> bits[1]
        strip, owner = rest & ((1 << bits[0]) - 1), rest >> bits[0]
    else:
        order = np.lexsort((inside, p, strip, owner))
        owner, strip, p, inside, s = owner[order], strip[order], p[order], inside[order], s[order]
    a = p + (strip + lowest) * half + inside
    other = np.r_[True, (owner[1:] != owner[:-1]) | (strip[1:] != strip[:-1])]
    apart = np.where(other, 1 << 40, np.r_[0, p[1:] - p[:-1]])
    new_place, out, free = apart > 0, [], np.ones(len(p), bool)
    upto, seeds = np.cumsum(new_place), np.cumsum(s)
    for gap in (limits.gap, limits.tight):
        first = np.flatnonzero(apart > gap)
        last = np.append(first[1:], len(p)) - 1
        length = p[last] + limits.q - p[first]
        long = np.flatnonzero(free[first] & (length >= least[owner[first]]))
        f, e, n = first[long], last[long], length[long]
        enough = (upto[e] - upto[f] + 1 >= limits.grams(n)) & (seeds[e] - seeds[f] + s[f] > 0)
        f, e = f[enough], e[enough]
        out.append(np.stack([owner[f], p[f], p[e] + limits.q, a[f], a[e] + limits.q, f, e], axis=1))
        for x, y in zip(f.tolist(), e.tolist()):
            free[x : y + 1] = False
    found = np.concatenate(out)
    return Regions(found[np.argsort(found[:, 0], kind="stable")], p, a)


def distance(a: str, b: str, budget: int) -> int | None:
    """Edits that make ``b`` of ``a``, seen in a band of ``budget`` diagonals on either side, a column of it as two bit vectors; None if over the budget."""
    m, n = len(a), len(b)
    if abs(m - n) > budget:
        return None
    if a == b:
        return 0
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    mask = (1 << (2 * budget + 1)) - 1
    diagonal = 1 << budget
    # Bit t of column j is row j - budget + t; rows up to 0 lie flat, those after rise by one.
    up, down, cost, shift = mask ^ (diagonal - 1), 0, 0, -budget
    for c in b:
        equal = rows.get(c, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        d0 = (((equal & up) + up) ^ up) | equal | down
        d0 &= mask
        plus = down | (mask ^ (d0 | up))
        minus = d0 & up
        if not d0 & diagonal:
            cost += 1
            if cost > 2 * budget:
                return None
        d0 >>= 1
        up = minus | (mask ^ (d0 | plus))
        down = d0 & plus
        shift += 1
    if m > n:
        between = ((1 << (m - n)) - 1) << budget
        cost += (up & between).bit_count() - (down & between).bit_count()
    elif n > m:
        between = ((1 << (n - m)) - 1) << (budget - (n - m))
        cost -= (up & between).bit_count() - (down & between).bit_count()
    return cost if cost <= budget else None


def chained(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (place from, to, text from, to), those in the item's order that together cover most of it.

    Each follows one whose text begins no later: one that ends before it in the item, or one that it goes on beyond. The best of
    either is asked of a tree over the places in the text, so many passages cost little more than each by itself.
    """
    found = sorted(set(found))
    by_text = sorted(range(len(found)), key=lambda n: (found[n][2], n))
    leaf = {n: k for k, n in enumerate(by_text)}
    starts = [found[n][2] for n in by_text]
    size = 1 << max(1, len(found)).bit_length()
    nothing = (-(1 << 60), -1)
    ended, open_ = [nothing] * (2 * size), [nothing] * (2 * size)
    waiting: list[tuple[int, int]] = []
    best: list[tuple[int, int]] = []

    def put(tree: list, n: int, value: tuple[int, int]) -> None:
        k = leaf[n] + size
        tree[k] = value
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])

    def top(tree: list, end: int) -> tuple[int, int]:
        k, j, most = size, size + end, nothing
        while k < j:
            if j & 1:
                j -= 1
                most = max(most, tree[j])
            k, j = k // 2, j // 2
        return most

    for n, (p, q, s, _) in enumerate(found):
        while waiting and waiting[0][0] <= p:
            _, m = heapq.heappop(waiting)
            put(ended, m, (best[m][0], m))
            put(open_, m, nothing)
        end = bisect.bisect_right(starts, s)
        after, over = top(ended, end), top(open_, end)
        value = max((q - p, -1), (after[0] + q - p, after[1]), (over[0] + q, over[1]))
        best.append(value)
        put(open_, n, (value[0] - q, n))
        heapq.heappush(waiting, (q, n))
    at = max(range(len(found)), key=lambda n: best[n][0]) if found else -1
    out = []
    while at >= 0:
        out.append(found[at])
        at = best[at][1]
    return out[::-1]


def verified(text: str, whole: str, found: Regions, row: np.ndarray, least: int, limits: Limits) -> list[tuple[int, int, int, int]]:
    """The passages of a region, as (place from, to, text from, to).

    It is one if it aligns within its budget; otherwise it is cut at the widest gap between its hits, and each side asked. An
    end of a passage beyond a gap is taken off if more than a third of it is edits, which the budget of a long passage would bear.
    """
    out, open_, q = [], [(int(row[5]), int(row[6]))], limits.q

    def span(first: int, last: int) -> tuple[int, int, int, int]:
        return int(found.place[first]), int(found.place[last]) + q, int(found.at[first]), int(found.at[last]) + q

    def alike(p: int, p_end: int, s: int, s_end: int) -> bool:
        return s_end >= s and distance(text[p:p_end], whole[s:s_end], max(p_end - p, s_end - s) // 3) is not None

    while open_:
        first, last = open_.pop()
        p, p_end, s, s_end = span(first, last)
        if p_end - p < least or s_end <= s:
            continue
        apart = np.diff(found.place[first : last + 1])
        if distance(text[p:p_end], whole[s:s_end], int(limits.budget(max(p_end - p, s_end - s)))) is None:
            if len(apart):
                at = first + int(apart.argmax())
                open_ += [(first, at), (at + 1, last)]
            continue
        gaps = (first + np.flatnonzero(apart > q)).tolist()
        while gaps and not alike(int(found.place[gaps[-1]]) + q, p_end, int(found.at[gaps[-1]]) + q, s_end):
            last = gaps.pop()
            _, p_end, _, s_end = span(first, last)
        while gaps and not alike(p, int(found.place[gaps[0] + 1]), s, int(found.at[gaps[0] + 1])):
            first = gaps.pop(0) + 1
            p, _, s, _ = span(first, last)
        if p_end - p >= least:
            out.append((p, p_end, s, s_end))
    return out


def grown(text: str, words: np.ndarray, whole: str, passage: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A passage with the words of its item on either side that the text repeats there, each with at most one edit (none in under four letters)."""
    p, p_end, s, s_end = passage

    def step(part: str, near: Callable[[int], str]) -> int | None:
        n = len(part)
        return next((m for m in (n, n - 1, n + 1) if distance(part, near(m), 1 if n >= 4 else 0) is not None), None)

    while p_end < len(text):
        end = int(np.searchsorted(words, words[p_end], side="right"))
        m = step(text[p_end:end], lambda m: whole[s_end : s_end + m])
        if m is None:
            break
        p_end, s_end = end, s_end + m
    while p > 0:
        start = int(np.searchsorted(words, words[p - 1]))
        m = step(text[start:p], lambda m: whole[max(0, s - m) : s])
        if m is None:
            break
        p, s = start, s - m
    return p, p_end, s, s_end


def leaks_of(whole: str, h: list[np.ndarray], index: Index) -> list[tuple[int, list[int]]]:
    """For one squeezed text and the hashes of its q-grams, a list of blocks: (item, its words that stand in copied passages, in order), of items with at least one passage."""
    limits = index.limits
    parts = [index.hits(x, n * BLOCK) for n, x in enumerate(h)]
    at, key = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, np.int32))
    wanted = index.seeded(at, key).tolist()
    if not wanted:
        return []
    found = regions(*index.places(at, key, wanted), index.least, index.fewest, limits)
    out = []
    for rows in np.split(found.rows, np.flatnonzero(np.diff(found.rows[:, 0])) + 1) if len(found.rows) else []:
        i = int(rows[0, 0])
        text, least = index.texts[i], int(index.least[i])
        sure = {x for row in rows for x in verified(text, whole, found, row, least, limits)}
        words = _words(index, i, [x[:2] for x in chained([grown(text, index.words[i], whole, x) for x in sure])])
        if len(words):
            out.append((index.ids[i], words.tolist()))
    return out


def _words(index: Index, item: int, found: list) -> np.ndarray:
    """Words of an item at least half of which lies in the passages found."""
    words = index.words[item]
    marks = np.zeros(len(words), bool)
    for p, p_end in found:
        marks[p:p_end] = True
    return np.flatnonzero(2 * np.bincount(words, marks, index.sizes[item]) >= np.bincount(words, minlength=index.sizes[item]))


def tiny_leaks(text: str, index: Index) -> list[tuple[int, list[int]]]:
    """Items of fewer letters than a q-gram, found where all their words stand in the text one after the other."""
    parts = [p for p in map(squeezed, text.split()) if p]
    found = {key for n in {len(k) for k in index.tiny} for key in zip(*(parts[k:] for k in range(n))) if key in index.tiny}
    return [(index.ids[i], list(range(len(key)))) for key in sorted(found) for i in index.tiny[key]]


def covers(words: list[int], size: int) -> bool:
    """Whether words that follow each other are half of an item or more."""
    runs = np.diff(np.flatnonzero(np.r_[True, np.diff(words) != 1, True])) if words else np.zeros(1, int)
    return bool(2 * runs.max() >= size)


def scanned(text: str | None, index: Index) -> tuple[int, list[tuple[int, list[int]]]]:
    """A text's sketch (the least hash of its q-grams, which two texts share with the likelihood of the share of q-grams that both have; 0 without any) and its leaks."""
    whole = squeezed(text or "")
    codes, q = codes_of(whole), index.limits.q
    h = [hashes(codes[at : at + BLOCK + q - 1], q) for at in range(0, len(codes) - q + 1, BLOCK)]
    return (int(min(x.min() for x in h)) >> 1 if h else 0), leaks_of(whole, h, index) + (tiny_leaks(text or "", index) if index.tiny else [])


SCHEMA = "doc_id bigint, item bigint, words array<int>, covers boolean, docket bigint, sketch bigint"


def passages(documents: DataFrame, items: list[tuple[int, str]], limits: Limits) -> DataFrame:
    """(doc_id, item, words, covers) for each document and numbered text with at least one copied passage, and a row without an item for each document; see leaks_of.

    Each row has its document's contexts: ``sketch``, and ``docket``, a hash of docket_no or else the sketch.
    """
    index = documents.sparkSession.sparkContext.broadcast(build_index(items, limits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = dict(zip(index.value.ids, index.value.sizes))
        for batch in batches:
            rows = []
            for doc, docket, text in zip(batch.column("doc_id").to_pylist(), batch.column("docket").to_pylist(), batch.column("text")):
                least, leaks = scanned(text.as_py(), index.value)
                contexts = (least if docket is None else docket, least)
                rows.append((doc, None, [], False, *contexts))
                rows.extend((doc, item, words, covers(words, sizes[item]), *contexts) for item, words in leaks)
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item", "words", "covers", "docket", "sketch"])

    number = F.trim(F.col("docket_no").cast("string")) if "docket_no" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", F.when(number != "", F.xxhash64(number)).alias("docket"), "text").mapInArrow(scan, SCHEMA)


def _turns(rows: DataFrame, most_letters: int) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts in lists of up to so many characters, at least one list."""
    items: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if items and size + len(r["text"]) > most_letters:
            yield items
            items, size = [], 0
        items.append((r["item"], r["text"]))
        size += len(r["text"])
    yield items


def find_leaks(documents: DataFrame, bench_items: DataFrame, path: str, limits: Limits | None = None, most_letters: int = 4_000_000) -> DataFrame:
    """(item_id, doc_id, share): documents that repeat at least ``limits.share`` of an item's words as passages in its order.

    The distinct texts of items are numbered and stored. Texts of up to ``most_letters`` characters in all are indexed at a time and broadcast (some 25 bytes a character); more are
    taken in turns over the whole corpus. Documents are scanned where they lie, in whole and without a shuffle. What is found
    is kept at ``path``, and from all of it the words of each text are dropped that many contexts share (stock phrases; dockets by
    ``docket_no``, if documents have it). From a document that has half an item or more in one piece nothing is dropped.
    A null or empty text has no passages, an item without words is found nowhere, equal items are each found, in any number, an
    item with several texts is found with the greatest share that one of them has, and a document in the input twice is reported once.
    """
    limits = limits or Limits()
    items = bench_items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    texts = stored(items.select("text").distinct().withColumn("item", F.monotonically_increasing_id()), f"{path}/texts")
    found = None
    for turn, some in enumerate(_turns(texts, most_letters)):
        more = stored(passages(documents, some, limits), f"{path}/passages{turn}")
        if turn:
            more = more.where("item is not null")
        found = more if found is None else found.unionByName(more)
    contexts = ["docket", "sketch"]
    many = found.where("item is null").agg(*[F.count_distinct(c).alias(c) for c in contexts]).first()
    words = found.where("item is not null").select("item", "doc_id", "covers", *contexts, F.explode("words").alias("word"))
    stock = None
    for c in contexts:
        votes = words.select("item", "word", c).distinct().groupBy("item", "word").agg(F.count("*").alias("votes"))
        most = many[c] * limits.stock + 3 * (many[c] * limits.stock * (1 - limits.stock)) ** 0.5
        common = votes.where(F.col("votes") > most).select("item", "word")
        stock = common if stock is None else stock.join(common, ["item", "word"])
    kept = words.where("covers").select("item", "doc_id", "word").unionByName(words.where("not covers").select("item", "doc_id", "word").join(stock, ["item", "word"], "left_anti"))
    own = kept.distinct().groupBy("item", "doc_id").agg(F.count("*").alias("words"))
    sizes = texts.select("item", F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("[\\p{L}\\p{N}]"))).alias("size"))
    leaked = own.join(sizes, "item").withColumn("share", F.col("words") / F.col("size")).where(F.col("share") >= limits.share - 1e-9)
    named = items.join(texts, "text").select("item_id", "item")
    return leaked.join(named, "item").groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))

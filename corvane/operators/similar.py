"""Similarity join of short texts by sequence ratio: by rare letter pairs where texts have such, else in blocks of matrix products."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import Tables

#: Rows that a Python operator returns at once.
OUT_ROWS = 20_000
#: Pairs that a block compares in the time of one pair that meets by a token.
DEARER = 200
#: Texts that tell whether a large table's would meet too often.
ASKED = 20_000
#: Texts of a block's side at the most, and the blocks that small tables are cut into.
SIDE, CELLS = 65_536, 128
#: Columns of letters (a column's product is at least what two texts share in it) and bits of letter pairs.
LETTERS, BITS = 64, 256
#: Most kinds that letters are put together to, the letters told apart, texts that are asked for it, and texts of equal counts that are worth a run.
KINDS, COMMON, SOME, RUN = 6, 40, 4000, 25
#: Texts sent to their blocks at once.
DEALT = 1000
#: Texts whose near ones are looked up together; pairs scored, and pairs aligned, at once.
TILE, SCORED, ALIGNED = 48, 1 << 20, 1 << 15


def shared_pairs(n: int, least: float) -> int:
    """Adjacent letter pairs that a text of n letters shares at the least with any text of that ratio; 0 or less where none is certain.

    A ratio of r = 2m / (a + b) means m matched letters in common order. Each of the a - m other letters of the one text breaks
    at most two of its adjacent pairs, each of the b - m others of the other text parts at most one, so at least
    (a - 1) - 2 (a - m) - (b - m) = 3m - a - b - 1 pairs are in both.
    """
    shortest, longest = math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)
    return min((3 * math.ceil(least * (n + b) / 2 - 1e-9) - n - b - 1 for b in range(max(1, shortest), longest + 1)), default=0)


def lister(least: float):
    """(side, text, n, kept, token): adjacent pairs of each text, each with its number among equal ones, and how many of them may be kept.

    Texts so short that a partner may share no pair have their single letters too, and keep all.
    """
    needs: dict[int, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for side, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(text)
                if n not in needs:
                    needs[n] = shared_pairs(n, least)
                grams = [text[i : i + 2] for i in range(n - 1)]
                if needs[n] <= 0:
                    grams += list(text)
                seen: Counter = Counter()
                kept = len(grams) - max(0, needs[n] - 1)
                for gram in grams:
                    seen[gram] += 1
                    rows.append((side, text, n, kept, f"{gram}\u0000{seen[gram]}"))
            for i in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + OUT_ROWS]), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["side", "text", "n", "kept", "token"])

    return run


def bounded_ratio(a: str, b: str, least: float) -> float | None:
    """The ratio if it is ``least`` or more. Letters in common bound it from above, so most texts need no alignment."""
    if 2 * sum((Counter(a) & Counter(b)).values()) < least * (len(a) + len(b)):
        return None
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return ratio if ratio >= least else None


def verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, r) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (r := bounded_ratio(a, b, least)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64()))], ["a", "b", "ratio"])

    return run


def matched(a: int, b: int, least: float) -> int:
    """Letters that texts of a and b letters match at the least."""
    return math.ceil(least * (a + b) / 2 - 1e-9)


class Letters:
    """Letters of texts, one after the other: text, place in it and code point of each."""

    def __init__(self, texts: list[str]):
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.n)
        self.at = np.arange(len(self.row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def counts(self, kinds: dict[int, int], width: int) -> np.ndarray:
        """Letters of each kind in each text; those that have none are of kind 0."""
        known = np.array(sorted(kinds) or [0], np.int64)
        place = np.minimum(np.searchsorted(known, self.points), len(known) - 1)
        kind = np.where(known[place] == self.points, np.array([kinds.get(k, 0) for k in known.tolist()])[place], 0)
        return np.bincount(self.row * width + kind, minlength=len(self.n) * width).reshape(len(self.n), width)


def numbered(row: np.ndarray, token: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token with its number among equal ones of the text), for tokens of so many bits; numbers from 15 on are one."""
    key = np.sort(row << bits | token)
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    number = np.arange(len(key)) - np.repeat(fresh, np.diff(np.r_[fresh, len(key)]))
    return key >> bits, (key & ((1 << bits) - 1)) << 4 | np.minimum(number, 15)


def mixed(token: np.ndarray, bits: int) -> np.ndarray:
    """A hash of so many bits."""
    with np.errstate(over="ignore"):
        h = token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((h ^ h >> np.uint64(29)) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)).astype(np.int64)


class Side:
    """Texts in order of initial (if asked) and counts of letter kinds, with what their comparison needs."""

    def __init__(self, texts: list[str], initial: bool, kinds: dict[int, int]):
        letters = Letters(texts)
        marks = letters.counts(kinds, 1 + max(kinds.values(), default=0))
        first = letters.points[letters.at == 0]
        marks = np.column_stack([first if initial else np.zeros_like(first), marks])
        order = np.lexsort(marks.T[::-1])
        self.texts, marks = [texts[k] for k in order.tolist()], marks[order]
        letters = Letters(self.texts)
        self.n, self.points, self.row, self.at = letters.n, letters.points, letters.row, letters.at
        #: Where each run of equal marks begins, where the last ends, and the marks of each.
        self.edges = np.r_[np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)]), len(marks)]
        self.marks = marks[self.edges[:-1]]
        self.lengths = self.marks[:, 1:].sum(1)
        self.tokens = numbered(self.row, self.points, 21)
        #: Adjacent letter pairs as bits: a bit of one text that another lacks is a pair that it lacks.
        same = self.row[1:] == self.row[:-1]
        row, token = numbered(self.row[1:][same], mixed(self.points[:-1] << 21 | self.points[1:], 30)[same], 30)
        place = mixed(token, 8)
        self.bits = np.zeros((BITS // 64, len(self.texts)), np.uint64)
        np.bitwise_or.at(self.bits, (place >> 6, row), np.uint64(1) << (place & 63).astype(np.uint64))
        self.ones = np.bitwise_count(self.bits).sum(0, dtype=np.int64)

    def held(self, columns: np.ndarray) -> np.ndarray:
        """How many tokens of each text fall in each column; the common ones have their own, others share the last."""
        row, token = self.tokens
        place = np.minimum(np.searchsorted(columns, token), len(columns) - 1)
        place = np.where(columns[place] == token, place, len(columns))
        return np.bincount(row * (LETTERS - 2) + place, minlength=len(self.texts) * (LETTERS - 2)).reshape(-1, LETTERS - 2).astype(np.float32)

    def coded(self, alphabet: np.ndarray) -> np.ndarray:
        """The number of each letter, text by place, at most 64 places; -1 where there is none."""
        out = np.full((len(self.texts), min(64, int(self.n.max(initial=1)))), -1, np.int32)
        near = self.at < out.shape[1]
        out[self.row[near], self.at[near]] = np.searchsorted(alphabet, self.points[near])
        return out


def masks(coded: np.ndarray) -> np.ndarray:
    """Text by bucket: the places of its letters as bits; the last bucket is empty."""
    out = np.zeros((len(coded), 65), np.uint64)
    rows = np.arange(len(coded))
    for place in range(coded.shape[1]):
        out[rows, np.where(coded[:, place] < 0, 64, coded[:, place] % 64)] |= np.uint64(1 << place)
    out[:, 64] = 0
    return out


def common(held: tuple[np.ndarray, np.ndarray], n: np.ndarray, coded: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of buckets, of texts with masks and of coded ones, n and m letters: never less than that of letters.

    ``held`` is the masks of all texts in one line and the first of each pair's; coded texts are in order of length, the longest first.
    """
    flat, first = held
    left = np.full(len(n), np.uint64(0xFFFFFFFFFFFFFFFF))
    until = np.searchsorted(-m, -np.arange(coded.shape[1]), "left")
    with np.errstate(over="ignore"):
        for place, some in enumerate(until.tolist()):
            if not some:
                break
            now = left[:some]
            met = now & flat[first[:some] + coded[:some, place] % 64]
            left[:some] = (now + met) | (now - met)
    return np.bitwise_count(~left & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - n).astype(np.uint64))).astype(np.int64)


def gestalt(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Matched letters of each pair of coded texts of n and m letters, as SequenceMatcher counts them.

    The longest block in common, the first of such in a, then in b; then the same left and right of it.
    """
    total = np.zeros(len(a), np.int64)
    pair, lo, hi, low, high = np.arange(len(a)), np.zeros_like(n), n, np.zeros_like(m), m
    places = np.arange(b.shape[1])[:, None]
    while len(pair):
        x, y = np.ascontiguousarray(a[pair].T), np.ascontiguousarray(b[pair].T)
        y = np.where((places >= low) & (places < high), y, -2)
        run = np.zeros((len(places), len(pair)), np.int8)
        size, one, two = np.zeros(len(pair), np.int8), np.zeros_like(lo), np.zeros_like(lo)
        for p in range(int(lo.min()), int(hi.max())):
            grown = np.ones_like(run)
            grown[1:] += run[:-1]
            run = grown * ((y == x[p]) & (p >= lo) & (p < hi))
            best = run.argmax(0)
            longest = np.take_along_axis(run, best[None], 0)[0]
            more = longest > size
            size[more], one[more], two[more] = longest[more], p + 1 - longest[more], best[more] + 1 - longest[more]
        hit = size > 0
        pair, lo, hi, low, high, size, one, two = (v[hit] for v in (pair, lo, hi, low, high, size.astype(np.int64), one, two))
        np.add.at(total, pair, size)
        pair, lo, hi, low, high = np.r_[pair, pair], np.r_[lo, one + size], np.r_[one, hi], np.r_[low, two + size], np.r_[two, high]
        rest = (lo < hi) & (low < high)
        pair, lo, hi, low, high = (v[rest] for v in (pair, lo, hi, low, high))
    return total


def compared(left: list[str], right: list[str] | None, ordered: bool, least: float, apart: int | None, initial: bool, kinds: dict[int, int] = {}) -> Iterator[tuple[list[str], list[str], list[float]]]:
    """(a, b, ratio) of the pairs of a block. Without ``right`` those within ``left``; ``ordered``: a is the smaller text.

    Texts a, b that match m letters are apart by a + b - 2m letters; counts of letter kinds differ by that at most. Runs of texts of near
    counts are compared by a matrix product, the letters in common; then pairs in common, the longest common subsequence, and the ratio.
    """
    x = Side(left, initial, kinds)
    y = x if right is None else Side(right, initial, kinds)
    tokens, often = np.unique(np.concatenate([x.tokens[1], y.tokens[1]]), return_counts=True)
    columns = np.sort(tokens[np.argsort(-often, kind="stable")[: LETTERS - 3]])
    one, other = (np.column_stack([s.held(columns), *end]) for s, end in ((x, (-least / 2 * x.n, np.ones(len(x.n)))), (y, (np.ones(len(y.n)), -least / 2 * y.n))))
    one, other = one.astype(np.float32), other.astype(np.float32)
    alphabet = np.unique(np.concatenate([x.points, y.points]))
    coded, codes = x.coded(alphabet), y.coded(alphabet)
    places = masks(coded)
    held: list[tuple] = []
    aligned: list[tuple] = []
    needs = np.ceil(least * np.arange(int(x.n.max() + y.n.max()) + 1) / 2 - 1e-9).astype(np.int64)
    slack = 0.01 + 1e-6 * float(x.n.max() + y.n.max())
    run = 0
    while run < len(x.marks):
        until = run + 1  # small runs are taken together
        while until < len(x.marks) and x.edges[until + 1] - x.edges[run] <= TILE and x.marks[until, 0] == x.marks[run, 0]:
            until += 1
        low, high = x.marks[run:until].min(0), x.marks[run:until].max(0)
        shortest, longest = x.lengths[run:until].min(), x.lengths[run:until].max()
        off = np.maximum(np.maximum(low - y.marks, y.marks - high), 0)[:, 1:].sum(1)
        near = (off <= (1 - least) * (longest + y.lengths) + 1e-9) & (y.marks[:, 0] == low[0])
        if until == run + 1:
            near &= off <= longest + y.lengths - 2 * np.ceil(least * (longest + y.lengths) / 2 - 1e-9)
        if apart is not None:
            near &= (y.lengths >= shortest - apart) & (y.lengths <= longest + apart)
        if right is None:
            near[:run] = False
        begin, end = x.edges[run], x.edges[until]
        run = until
        rows = np.flatnonzero(np.repeat(near, np.diff(y.edges)))
        if not len(rows):
            continue
        facing = np.ascontiguousarray(other[rows])
        step = max(1, SCORED // len(rows))
        for at in range(begin, end, step):
            found = np.flatnonzero((one[at : min(end, at + step)] @ facing.T).ravel() >= -slack)
            i, j = found // len(rows) + at, rows[found % len(rows)]
            if right is None:
                i, j = i[i < j], j[i < j]
            n, m = x.n[i], y.n[j]
            need = needs[n + m]
            lacks = sum(np.bitwise_count(p[i] & ~q[j]).astype(np.int64) for p, q in zip(x.bits, y.bits))
            fits = (lacks <= 2 * n + m - 3 * need) & (lacks + y.ones[j] - x.ones[i] <= 2 * m + n - 3 * need) & (need <= np.minimum(n, m))
            if apart is not None:
                fits &= np.abs(n - m) <= apart
            held.append((i[fits], j[fits], need[fits]))
            if sum(len(h[0]) for h in held) >= ALIGNED:
                aligned.append(fitting(x, y, *map(np.concatenate, zip(*held)), codes, places))
                held = []
            if sum(len(h[0]) for h in aligned) >= ALIGNED:
                yield scored(x, y, *map(np.concatenate, zip(*aligned)), coded, codes, ordered, least)
                aligned = []
    if held:
        aligned.append(fitting(x, y, *map(np.concatenate, zip(*held)), codes, places))
    if aligned:
        yield scored(x, y, *map(np.concatenate, zip(*aligned)), coded, codes, ordered, least)


def fitting(x: Side, y: Side, i: np.ndarray, j: np.ndarray, need: np.ndarray, codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs i, j that may match so many letters in common order; longer texts than 64 letters stay."""
    fits = np.ones(len(i), bool)
    for k in range(0, len(i), ALIGNED):
        short = k + np.flatnonzero((x.n[i[k : k + ALIGNED]] <= 64) & (y.n[j[k : k + ALIGNED]] <= 64))
        short = short[np.argsort(-y.n[j[short]], kind="stable")]
        fits[short] = common((places.ravel(), i[short] * places.shape[1]), x.n[i[short]], codes[j[short]], y.n[j[short]]) >= need[short]
    return i[fits], j[fits]


def scored(x: Side, y: Side, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, ordered: bool, least: float) -> tuple[list[str], list[str], list[float]]:
    """Those of the pairs i, j whose ratio is ``least`` or more."""
    short = (x.n[i] <= 64) & (y.n[j] <= 64)
    first, second = [x.texts[k] for k in i.tolist()], [y.texts[k] for k in j.tolist()]
    turned = np.array([ordered and p > q for p, q in zip(first, second)], bool)
    first, second = [q if t else p for p, q, t in zip(first, second, turned)], [p if t else q for p, q, t in zip(first, second, turned)]
    ratio = np.zeros(len(i))
    for way, (p, q, s, t) in ((False, (a, b, i, j)), (True, (b, a, j, i))):
        these = np.flatnonzero(short & (turned == way))
        s, t = s[these], t[these]
        n, m = (x.n[s], y.n[t]) if not way else (y.n[s], x.n[t])
        ratio[these] = 2.0 * gestalt(p[s], q[t], n, m) / (n + m)
    for k in np.flatnonzero(~short).tolist():
        ratio[k] = SequenceMatcher(None, first[k], second[k], autojunk=False).ratio()
    kept = np.flatnonzero(ratio >= least).tolist()
    return [first[k] for k in kept], [second[k] for k in kept], ratio[kept].tolist()


def packed(texts: pa.Array, kinds: dict[int, int], width: int) -> np.ndarray:
    """Counts of letter kinds as one number a text, in the order of the counts; those over 1,023 are equal."""
    counts = np.minimum(Letters(texts.to_pylist()).counts(kinds, width), 1023)
    return (counts << np.arange(10 * width - 10, -1, -10)).sum(1)


def merged_kinds(some: list[str]) -> list[dict[int, int]]:
    """Kinds of the common letters of some texts, one for each number of kinds from 1: letters whose counts seldom cancel out are of one kind."""
    letters = Letters(some)
    points, often = np.unique(letters.points, return_counts=True)
    points = np.sort(points[np.argsort(-often, kind="stable")[:COMMON]])
    counts = letters.counts({p: k for k, p in enumerate(points.tolist())}, max(1, len(points))).astype(np.float32)
    half = len(some) // 2
    off = (counts[:half] - counts[half : 2 * half]).T  # a row for each kind: how far texts of a pair are apart in it
    groups = [[p] for p in points.tolist()]
    found = []
    while True:
        if len(groups) <= KINDS:
            found.append({p: k for k, group in enumerate(groups) for p in group})
        if len(groups) <= 1:
            return found[::-1]
        apart = np.abs(off).sum(1)
        losses = [apart[k] + apart[k + 1 :] - np.abs(off[k] + off[k + 1 :]).sum(1) for k in range(len(groups) - 1)]
        one = min(range(len(losses)), key=lambda k: losses[k].min())
        other = one + 1 + int(losses[one].argmin())
        off[one] += off[other]
        off, groups[one] = np.delete(off, other, 0), groups[one] + groups.pop(other)


def letter_kinds(texts: DataFrame, n: int) -> tuple[dict[int, int], int, list[tuple[int, int]]]:
    """(kind of each common letter, how many kinds, texts of each packed counts): as many kinds as leave RUN texts to equal counts.

    Some texts decide only how letters are put together; whichever way that is, the same pairs are found.
    """
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(0)), F.lit(max(1, n // SOME))) == 0).select("text").limit(2 * SOME).collect()
    dealt = merged_kinds([r["text"] for r in some])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(batch.column(0), kinds, k + 1)) for k, kinds in enumerate(dealt)], [f"k{k}" for k in range(len(dealt))])

    every = texts.select("text").mapInArrow(counts, ", ".join(f"k{k} long" for k in range(len(dealt))))
    different = every.agg(*(F.approx_count_distinct(f"k{k}") for k in range(len(dealt)))).first()
    width = max((k + 1 for k in range(len(dealt)) if different[k] * RUN <= n), default=1)
    sizes = every.groupBy(F.col(f"k{width - 1}").alias("counts")).agg(F.count("*").alias("n")).orderBy("counts").collect()  # n / RUN rows or so
    return dealt[width - 1], width, [(r["counts"], r["n"]) for r in sizes]


def ranges(sizes: list[tuple[int, int]], width: int, side: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed counts cut into ranges of about ``side`` texts: (first of each, its number, its parts where one is larger, which numbers may hold similar texts)."""
    starts, held, low, high, parts = [], [], [], [], []
    for code, n in sizes:
        counts = [code >> 10 * (width - 1 - k) & 1023 for k in range(width)]
        if not starts or held[-1] + n > side:
            starts, held, low, high = [*starts, code], [*held, 0], [*low, counts], [*high, counts]
        held[-1] += n
        low[-1], high[-1] = [min(p) for p in zip(low[-1], counts)], [max(p) for p in zip(high[-1], counts)]
    parts = np.array([-(-n // side) for n in held])
    base = np.cumsum(parts) - parts
    low, high = (np.repeat(np.array(v, float), parts, axis=0) for v in (low, np.where(np.array(high) == 1023, np.inf, high)))
    near = np.zeros((len(low), len(low)), bool)
    for k in range(len(low)):
        off = np.maximum(np.maximum(low[k] - high, low - high[k]), 0).sum(1)
        near[k] = off <= (1 - least) * (high[k].sum() + high.sum(1)) + 1e-9
    return np.array(starts), base, parts, near


def blocks(texts: DataFrame, sizes: list[int], within: bool, least: float, apart: int | None, initial: bool) -> DataFrame:
    """All pairs of distinct texts that may be similar, block by block: each text goes to blocks of a grid, and no task holds more than a block's sides.

    Within one table the grid's rows are ranges of counts of letter kinds, and blocks of ranges too far apart are left out; else texts are dealt by hash.
    """
    side = min(SIDE, max(1, math.isqrt(sizes[0] * sizes[-1] // CELLS)))
    if within:
        kinds, width, counted = letter_kinds(texts, sizes[0])
        starts, base, parts, near = ranges(counted, width, side, least)
        wide = len(near)
        i, j = np.nonzero(np.triu(near))
        own, other = np.r_[i, j[i != j]], np.r_[i * wide + j, (i * wide + j)[i != j]]
        order = np.argsort(own, kind="stable")
        cells, seconds = other[order], (np.arange(len(own)) >= len(i))[order]
        edges = np.searchsorted(own[order], np.arange(wide + 1))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.searchsorted(starts, packed(batch.column(0), kinds, width), "right") - 1
                part = [zlib.crc32(t.encode()) % p if p > 1 else 0 for t, p in zip(batch.column(0).to_pylist(), parts[at].tolist())]
                at = base[at] + np.array(part, np.int64)
                for k in range(0, len(at), DEALT):
                    some = at[k : k + DEALT]
                    n = edges[some + 1] - edges[some]
                    to = np.arange(n.sum()) + np.repeat(edges[some] - np.cumsum(n) + n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[to]), pa.array(seconds[to]), batch.column(0).take(pa.array(k + np.repeat(np.arange(len(some)), n)))], ["cell", "second", "text"])

        dealt = texts.select("text").mapInArrow(deal, "cell long, second boolean, text string")
        tasks = len(i)
    else:
        kinds = {}
        high, wide = (min(max(1, -(-n // side)), max(1, n)) for n in (sizes[0], sizes[-1]))
        number = F.pmod(F.xxhash64("text"), F.when(F.col("side") == 0, F.lit(high)).otherwise(F.lit(wide)))
        others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.lit(wide - 1)).otherwise(F.lit(high - 1)))).alias("j")
        dealt = texts.select("text", "side", number.alias("i"), others)
        dealt = dealt.select(F.when(F.col("side") == 0, F.col("i") * wide + F.col("j")).otherwise(F.col("j") * wide + F.col("i")).alias("cell"), (F.col("side") == 1).alias("second"), "text")
        tasks = high * wide

    def run(cell: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        whole = within and cell[0].as_py() // wide == cell[0].as_py() % wide
        one, other = (table.filter(pa.array(m)).column("text").to_pylist() for m in (~second, second))
        found = compared(one, None if whole else other, within, least, apart, initial, kinds) if one and (whole or other) else ()
        parts = [pa.table([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.float64()))], ["a", "b", "ratio"]) for rows in (([], [], []), *found)]
        return pa.concat_tables(parts)

    return dealt.repartition(min(2000, tasks), "cell").groupBy("cell").applyInArrow(run, "a string, b string, ratio double")


def kept_tokens(texts: DataFrame, least: float) -> DataFrame:
    """(side, text, n, token): the rarest tokens of each text, one of which it shares with every similar text."""
    listed = texts.mapInArrow(lister(least), "side int, text string, n int, kept int, token string")
    rare = listed.groupBy("token").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("side", "text").orderBy("texts", "token")
    return listed.join(rare, "token").withColumn("_n", F.row_number().over(order)).where("_n <= kept").select("side", "text", "n", "token")


def meetings(kept: DataFrame, within: bool) -> float:
    """How often texts would meet by tokens."""
    counts = kept.groupBy("token").agg(*(F.count_if(F.col("side") == s).cast("double").alias(f"n{s}") for s in (0, 1)))
    return counts.agg(F.sum(F.col("n0") * (F.col("n0") / 2 if within else F.col("n1")))).first()[0] or 0


def similar(left: DataFrame, right: DataFrame | None, least: float, apart: int | None = None, initial: bool = False) -> DataFrame:
    """(a, b, ratio): all texts of ``left`` and ``right`` (column text) whose sequence ratio is ``least`` or more, each pair of texts once.

    Without ``right`` the pairs a < b within ``left``. Repeated texts are one; null and empty ones pair with nothing. least is over 2/3.
    The ratio is that of (a, b) in this order, without a rule for popular letters. With ``apart`` lengths differ by so much at most; with
    ``initial`` the first letters are equal.

    Exact: two such texts share a certain number of adjacent letter pairs, so if each keeps its rarest ones, all but that number less one,
    they share a kept one. Texts meet by kept pairs only; lengths and letters in common are tested before the ratio is. Where all texts are
    made of few letter pairs (names of common syllables) so many would meet that they are compared in blocks instead; of a large table, some
    texts tell beforehand. Either way finds the same pairs.
    """
    if not least > 2 / 3:
        raise ValueError("least must be over 2/3")
    texts = left.select(F.lit(0).alias("side"), "text")
    if right is not None:
        texts = texts.unionAll(right.select(F.lit(1).alias("side"), "text"))
    tables = Tables(left.sparkSession, "similar")
    texts = tables.save(texts.where("text != ''").distinct(), "texts")
    sizes = {r["side"]: r["n"] for r in texts.groupBy("side").agg(F.count("*").alias("n")).collect()}  # one row of each side
    ends = [sizes.get(0, 0), sizes.get(0 if right is None else 1, 0)]
    if right is None and ends[0] > 2 * ASKED:
        some = tables.save(texts.where(F.pmod(F.xxhash64("text", F.lit(0)), F.lit(ends[0] // ASKED)) == 0), "some")
        if meetings(tables.save(kept_tokens(some, least), "asked"), True) * DEARER > some.count() ** 2 / 2:
            return blocks(texts, ends, True, least, apart, initial)
    kept = tables.save(kept_tokens(texts, least), "kept")
    if meetings(kept, right is None) * DEARER > ends[0] * ends[1] / (2 if right is None else 1):
        return blocks(texts, ends, right is None, least, apart, initial)
    a = kept.where("side = 0").select(F.col("text").alias("a"), F.col("n").alias("n_a"), "token")
    b = kept.where(F.lit(right is None) | (F.col("side") == 1)).select(F.col("text").alias("b"), F.col("n").alias("n_b"), "token")
    fits = 2 * F.least("n_a", "n_b") >= least * (F.col("n_a") + F.col("n_b")) - 1e-9
    if apart is not None:
        fits &= F.abs(F.col("n_a") - F.col("n_b")) <= apart
    if initial:
        fits &= F.substring("a", 1, 1) == F.substring("b", 1, 1)
    met = a.join(b, "token").where(fits & (F.col("a") < F.col("b") if right is None else F.lit(True)))
    return met.select("a", "b").distinct().mapInArrow(verifier(least), "a string, b string, ratio double")

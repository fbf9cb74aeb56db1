"""Benchmark decontamination: a BM25 index of test items, asked with every training passage.

Passages are runs of words that overlap by the longest item's length, so every run of words no longer
than an item lies whole in one passage. Impacts are normalised by the item's score for its own words,
so one threshold, a share of that score, serves all items. Postings carry the impact and each block of
items the largest impact of a term (block-max). Terms are essential or not: the non-essential ones,
the most frequent, can never lift an item over the threshold alone. A passage reaches a block only
where the block-max sum of its essential terms and the block's largest non-essential rest is at least
the threshold; a passage that reaches none is left, the postings of any other are summed in full once
for all the blocks it reaches, and all items above the threshold are kept.
Each is verified by the share of the item's word trigrams found in the passage, for the question (all
sentences but the last) and for the answer (the last) apart. A part of fewer than SHORT words has so few
trigrams that one edit can take them all, so the share of its words that stand there in order counts too.
An item is also verified as a whole, by half of all its trigrams, so that one without its short last
sentence, or with another one, is met; items of fewer than SHORT_ITEM words by three quarters of their words in order.

Document frequencies, the number of items, their mean and their longest length come from one aggregation
over the whole benchmark, so scores and passages are the same however the items are dealt. The index goes
to every task in parts of about PART_BYTES of items, so its size is bounded whatever the benchmark's, and
each part is asked with all passages; documents are read once for every GROUP parts, which a task holds
together. Null and empty texts have no passages; null or wordless items are never met; repeated rows
give one result per id and item. Result columns are new; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, emitted, serving, texts

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER, WHOLE = 0.55, 0.4, 0.4, 0.5
#: Parts and items of fewer words are also verified by their words in order, of which these shares are needed.
SHORT, SHORT_ITEM, ORDERED, ORDERED_ITEM = 6, 8, 0.6, 0.75
#: Words that may be added within them.
ADDED = 2
#: Largest rest that the non-essential terms may have.
REST = 0.3
BLOCK = 16
#: Text of a part of the index, and parts that a task holds.
PART_BYTES, GROUP = 8 << 20, 2
#: A-Z become a-z; letters, digits and bytes from 128 stay; all others become a space.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def split(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer, the last sentence; halves where there is one sentence."""
    whole = text.replace(b"\n", b". ").strip()
    cut = max(whole.rstrip(b".!? ").rfind(x) for x in (b". ", b"? ", b"! "))
    question, answer = split(whole[: cut + 1]), split(whole[cut + 1 :])
    if not question or not answer:
        both = question + answer
        question, answer = both[: len(both) // 2], both[len(both) // 2 :]
    return question, answer


@dataclass
class Index:
    items: list[int]
    vocabulary: dict[bytes, int]
    longest: int
    starts: np.ndarray  # term -> its first posting
    item: np.ndarray  # of each posting
    impact: np.ndarray
    block_starts: np.ndarray  # essential term -> its first (block, largest impact)
    block: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray
    rest: np.ndarray  # block -> largest non-essential sum
    words: list[tuple[np.ndarray, np.ndarray]]  # of the question and of the answer

    def grams(self, n: int) -> tuple[frozenset, frozenset, frozenset]:
        """Trigrams of an item's question, answer and whole; only of items that are met."""
        q, a = self.words[n]
        return trigrams(q), trigrams(a), trigrams(np.concatenate([q, a]))


def trigrams(ids: list[int] | np.ndarray) -> frozenset:
    ids = [int(i) for i in ids]
    width = min(3, len(ids))
    return frozenset(tuple(ids[i : i + width]) for i in range(len(ids) - width + 1)) if width else frozenset()


@dataclass
class Statistics:
    """Of the whole benchmark: items with words, their mean and longest length, items that hold each word."""

    items: int
    mean: float
    longest: int
    df: dict[bytes, int]


def measured(items: list[tuple[list[bytes], list[bytes]]]) -> Statistics:
    lengths = [len(q) + len(a) for q, a in items]
    return Statistics(len(items), sum(lengths) / max(len(lengths), 1), max(lengths, default=0), Counter(w for q, a in items for w in {*q, *a}))


def build(items: list[tuple[int, bytes]], stats: Statistics | None = None) -> Index | None:
    """The index of some items; ``stats`` are those of all items, or of these where they are all."""
    cut = [(i, parts(t)) for i, t in sorted(items)]
    cut = [(i, q, a) for i, (q, a) in cut if q or a]
    if not cut:
        return None
    stats = stats or measured([(q, a) for _, q, a in cut])
    tfs = [Counter(q + a) for _, q, a in cut]
    here = Counter(w for tf in tfs for w in tf)
    df = {w: stats.df[w] for w in here}
    order = sorted(here, key=lambda w: (-here[w], w))
    vocabulary = {w: i for i, w in enumerate(order)}
    lengths = np.array([sum(tf.values()) for tf in tfs], float)
    rows = []
    for n, tf in enumerate(tfs):
        found = {w: math.log(1 + (stats.items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[n] / stats.mean)) for w, c in tf.items()}
        own = sum(found.values())
        rows += [(vocabulary[w], n, s / own) for w, s in found.items()]
    rows.sort()
    term, item, impact = (np.array([r[i] for r in rows]) for i in range(3))
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    sums, essential = np.zeros(len(cut)), np.ones(len(order), bool)
    for t in range(len(order)):  # most frequent first
        own = slice(starts[t], starts[t + 1])
        after = sums[item[own]] + impact[own]
        if here[order[t]] < 2 or after.max() > REST:
            break
        sums[item[own]] = after
        essential[t] = False
    blocks = item // BLOCK
    rest = np.zeros(blocks.max() + 1)
    np.maximum.at(rest, np.arange(len(cut)) // BLOCK, sums)
    key, at = np.unique(term * len(rest) + blocks, return_inverse=True)
    top = np.zeros(len(key))
    np.maximum.at(top, at, impact)
    block_starts = np.searchsorted(key // len(rest), np.arange(len(order) + 1))
    words = [tuple(np.array([vocabulary[w] for w in part], np.int32) for part in (q, a)) for _, q, a in cut]
    return Index([i for i, *_ in cut], vocabulary, stats.longest, starts, item, impact, block_starts, key % len(rest), top, essential, rest, words)


def ranges(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all postings of ``terms``, and the place in ``terms`` of each."""
    n = starts[terms + 1] - starts[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[terms][of], of


def overlap(grams: frozenset, there: frozenset, ids: frozenset) -> float:
    if not grams:
        return 1.0
    return sum((g in there) if len(g) == 3 else all(x in ids for x in g) for g in grams) / len(grams)


def ordered(part: list[int], run: list[int]) -> float:
    """The largest share of the words of ``part`` that stand in order within its length and ADDED words of ``run``."""
    own, width, best = set(part), len(part) + ADDED, 0
    for start in (i for i, x in enumerate(run) if x in own):
        before = [0] * (len(part) + 1)
        for x in run[start : start + width]:
            after = [0]
            for j, y in enumerate(part):
                after.append(before[j] + 1 if x == y else max(before[j + 1], after[j]))
            before = after
        best = max(best, before[-1])
    return best / len(part)


def verified(index: Index, n: int, grams: frozenset, present: frozenset, run: list[int]) -> tuple[float, float] | None:
    """Question and answer overlap of item ``n`` with a passage; None where neither both parts nor the whole item are there."""
    shares = []
    question, answer, whole_grams = index.grams(n)
    for part, own, least in zip(index.words[n], (question, answer), (QUESTION, ANSWER)):
        share = overlap(own, grams, present)
        if share < least and len(part) < SHORT and (found := ordered(part.tolist(), run)) >= ORDERED:
            share = found
        shares.append(share)
    if shares[0] < QUESTION or shares[1] < ANSWER:
        whole = [x for part in index.words[n] for x in part.tolist()]
        if overlap(whole_grams, grams, present) < WHOLE and (len(whole) >= SHORT_ITEM or ordered(whole, run) < ORDERED_ITEM):
            return None
    return shares[0], shares[1]


def search(index: Index, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
    """item_id -> (score, question overlap, answer overlap) of the best verified passage of a text."""
    ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    if not len(ids):
        return {}
    stride, terms, blocks = index.longest, len(index.essential), len(index.rest)
    at = np.flatnonzero(ids >= 0)
    at = at[index.essential[ids[at]]]
    if not len(at):
        return {}
    # passage p holds the words from p * stride to (p + 2) * stride
    late = at // stride
    pairs = np.unique(np.concatenate([late, late[late > 0] - 1]) * terms + np.concatenate([ids[at], ids[at[late > 0]]]))
    where, of = ranges(index.block_starts, pairs % terms)
    bounds = np.bincount(np.unique(cells := (pairs // terms)[of] * blocks + index.block[where], return_inverse=True)[1], index.block_max[where])
    cells = np.unique(cells)
    found: dict[int, tuple[float, float, float]] = {}
    reached = cells[bounds + index.rest[cells % blocks] >= THRESHOLD] // blocks
    for passage in np.unique(reached).tolist():
        # all postings of a passage that reaches any block are summed at once; no item of another block can reach the threshold
        run = ids[passage * stride : (passage + 2) * stride]
        there = np.unique(run[run >= 0])
        postings, _ = ranges(index.starts, there)
        scores = np.bincount(index.item[postings], index.impact[postings])
        hits = np.flatnonzero(scores >= THRESHOLD)
        if len(hits):
            grams, present, words_ = trigrams(run), frozenset(there.tolist()), run.tolist()
        for n in hits.tolist():
            shares = verified(index, n, grams, present, words_)
            if shares:
                got = (float(scores[n]), *shares)
                found[index.items[n]] = max(got, found.get(index.items[n], got))
    return found


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


COUNTED = pa.schema([("word", pa.binary()), ("df", pa.int64()), ("words", pa.int64()), ("longest", pa.int64())])


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that hold each word; under a null word the number of items, their words and the longest."""
    for batch in batches:
        cut = [(q, a) for q, a in map(parts, texts(batch, "words")) if q or a]
        own = measured(cut)
        yield from emitted(iter([(None, own.items, sum(len(q) + len(a) for q, a in cut), own.longest), *((w, n, 0, 0) for w, n in own.df.items())]), COUNTED)


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[list[Broadcast], bool]]:
    """Groups of indexes of parts of the items, sent to all tasks, and whether more may follow; the caller ends with one before it asks for the next."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("words")).where("item is not null and words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0]
    if not size:
        return
    counted = items.select("words").mapInArrow(counter, "word binary, df long, words long, longest long")
    counted = counted.groupBy("word").agg(F.sum("df").alias("df"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    space = Workspace(benchmark.sparkSession, "benchmark")
    counted = space.save(counted, "words")
    every = counted.where("word is null").first()
    count = size // PART_BYTES + 1
    group: list[Broadcast] = []
    for part in range(count):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == part)
        texts_ = [(r["item"], r["words"].encode()) for r in own.collect()]  # about PART_BYTES
        if count == 1:
            known = counted.where("word is not null")
        else:  # the words of this part alone
            known = counted.join(own.mapInArrow(counter, "word binary, df long, words long, longest long").select("word").distinct(), "word", "left_semi")
        df = {bytes(r["word"]): r["df"] for r in known.select("word", "df").collect()}
        index = build(texts_, Statistics(every["df"], every["words"] / max(every["df"], 1), every["longest"], df))
        if index is not None:
            group.append(benchmark.sparkSession.sparkContext.broadcast(index))
        if len(group) == GROUP:
            yield group, part < count - 1
            group = []
    if group:
        yield group, False


def ended(group: list[Broadcast]) -> None:
    """Give up the indexes of a group whose results are written."""
    for shared in group:
        shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each (document, item) met and verified: HITS.

    An index of more than one group is asked group by group: hits are written and the group is given up before the next one is built.
    """
    space = Workspace(docs.sparkSession, "hits")
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = None
    for turn, (group, more) in enumerate(indexes(benchmark, item_col, item_text_col)):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            serving("decontaminate")

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                        words = split(text)
                        for item, got in sorted(x for shared in group for x in search(shared.value, words).items()):
                            yield doc_id, item, *got

            yield from emitted(rows(), HITS_ARROW)

        hits = chosen.mapInArrow(run, HITS)
        if more:
            hits = space.save(hits, f"hits{turn}")
            ended(group)
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], HITS)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("top")).select("doc_id", "item_id", "top.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, whatever their ids. Groups of indexes go one by one, as in ``contaminated``."""
    space = Workspace(docs.sparkSession, "clean")
    for turn, (group, more) in enumerate(indexes(benchmark, item_col, item_text_col)):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            serving("decontaminate")
            for batch in batches:
                own = (split(text) for text in texts(batch, text_col))
                yield batch.filter(pa.array([not any(search(shared.value, words) for shared in group) for words in own], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = space.save(docs, f"kept{turn}")
            ended(group)
            if turn:
                space.drop(f"kept{turn - 1}")
    return docs

"""LM scoring: a hidden Markov language model.

The latent states emit symbols; a symbol is a frequent word, the end of a text, or a class of
words that share a hash of their last three bytes. Within its class a word is drawn by its smoothed
corpus count, and so is one unseen word of each class: P(word | state) = P(symbol | state) *
(c + 0.5) / (N_class + 0.5 * (V_class + 1)), where c, N_class and V_class cover all training texts.
A text's likelihood is the exact scaled forward recursion over its symbols, whole, times the
within-class terms of its words.

Training is Baum-Welch. SETTLE passes over one 32nd of the training texts part the states; then each of
PASSES passes covers all training texts, whole: every task sums expected counts by the forward and
backward recursions over its texts, the counts are added up across partitions by a grouped sum, and the
model is set anew from them alone (with the prior's pseudo-counts), so every text weighs the same. Each
pass also sums the likelihood, which with the prior's term doesn't fall from one full pass to the next.
Only the model itself, of a size fixed by its parameters, reaches the driver.

Word counts of the texts come from one table of all words. A histogram of the counts gives the least
count that no more than HOT words have; those words go to all tasks, and every other word of a text is
joined with that table by shuffle.

Null and empty texts hold the end alone. Repeated rows are scored each. A null id belongs to the
fold of the empty text. Without training texts scores use the prior alone. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, emitted, fold, texts, words

#: States, symbols of single words, classes of the other words, words whose counts go to all tasks at most.
STATES, OWN, CLASSES, HOT = 12, 2048, 2048, 65_536
#: Passes over a 32nd of the training texts, then over all of them; pseudo-counts of the prior.
SETTLE, PASSES, PRIOR = 4, 3, 20.0
#: Steps times sequences of a batch, sequences of a batch, symbols held before they are sorted by length.
CELLS, WIDTH, SYMBOLS = 1 << 20, 1024, 4_000_000
END = b""
#: Words counted before they are handed on; texts encoded at once.
HELD, TEXTS = 150_000, 256


def class_of(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % CLASSES


def counter():
    """Word counts of the training texts of a partition, in parts of bounded size."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, apart in zip(texts(batch), batch.column(1).to_pylist()):
                if not apart:
                    found = words(text)
                    for at in range(0, len(found), HELD):
                        counts.update(found[at : at + HELD])
                        if len(counts) > HELD:
                            yield from emitted(iter(counts.items()), schema)
                            counts.clear()
                    counts[END] += 1
        yield from emitted(iter(counts.items()), schema)

    return run


class Places(dict):
    """Place of each hot word; -1 for any other, which is not added."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Classes(dict):
    """Symbol of each word that isn't hot."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        s = self[word] = class_of(word)
        return s


@dataclass
class Words:
    """What all tasks know of the hot words, by place: word, log10(c + 0.5), symbol."""

    words: list[bytes]
    log: np.ndarray
    symbol: np.ndarray


ROW = "row long, doc_id long, held_out boolean, share int, n_tokens long, known long, log_own double, log_class double, symbols binary, rare array<struct<word: binary, tf: int>>"
ROW_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("share", pa.int32()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_own", pa.float64()), ("log_class", pa.float64()), ("symbols", pa.binary())]
    + [("rare", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())])))]
)


def encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Words = shared.value
        place, of_class = Places(zip(hot.words, range(len(hot.words)))).__getitem__, Classes().__getitem__
        log, symbol = np.append(hot.log, 0.0), np.append(hot.symbol, 0)  # the last is for words that aren't hot
        single = symbol < OWN
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                tokens, known, own, inner, symbols, words_, tfs, ends = [], [], [], [], [], [], [], [0]
                for text in texts(batch):
                    found = [*words(text), END]
                    places = np.fromiter(map(place, found), np.int32, len(found))
                    s, logs, alone = symbol[places], log[places], single[places]
                    rare = np.flatnonzero(places < 0).tolist()
                    if rare:
                        others = [found[i] for i in rare]
                        s[rare] = np.fromiter(map(of_class, others), np.int32, len(others))
                        counts = Counter(others)
                        words_ += counts.keys()
                        tfs += counts.values()
                    ends.append(len(words_))
                    tokens.append(len(found))
                    known.append(len(found) - len(rare))
                    own.append(float(logs[alone].sum()))
                    inner.append(float(logs[~alone].sum()))
                    symbols.append(s.astype("<u2").tobytes())
                each = pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(tfs, pa.int32())], ["word", "tf"])
                heads = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(2), batch.column(1), batch.column(3)]
                more = [pa.array(x, t) for x, t in zip((tokens, known, own, inner, symbols), ROW_ARROW.types[4:9])]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([*heads, *more, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], schema=ROW_ARROW)

    return run


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def fresh(unigram: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), STATES))
    move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batched(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of sequences, which are sorted by falling length, of at most CELLS padded symbols."""
    at = 0
    while at < len(sequences):
        n = max(1, min(WIDTH, CELLS // len(sequences[at])))
        yield sequences[at : at + n]
        at += n


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by step and sequence, longest first, and how many sequences are alive at each step."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths[0], len(sequences)), np.int32)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of sequences sorted by falling length, and the log of their likelihood."""
    sym, alive = padded(sequences)
    steps, width = sym.shape
    k = len(model.start)
    onward, ahead_of = np.ascontiguousarray(model.move.T, np.float32), model.move.astype(np.float32)
    emit = np.ascontiguousarray(model.emit.T, np.float32)
    a, scale = np.zeros((steps, k, width), np.float32), np.ones((steps, width), np.float32)
    now = model.start.astype(np.float32)[:, None] * emit[:, sym[0]]
    for t in range(steps):
        n = alive[t]
        if t:
            now = onward @ now[:, :n]
            now *= emit.take(sym[t, :n], axis=1)
        c = now.sum(0)
        now /= c
        scale[t, :n], a[t, :, :n] = c, now
    moves = np.zeros((k, k), np.float64)
    back = np.ones((k, width), np.float32)
    for t in range(steps - 2, -1, -1):
        n = alive[t + 1]
        ahead = emit.take(sym[t + 1, :n], axis=1)
        ahead *= back[:, :n]
        a[t + 1, :, :n] *= back[:, :n]
        ahead /= scale[t + 1, :n]
        moves += a[t, :, :n] @ ahead.T
        back[:, :n] = ahead_of @ ahead
    a[0] *= back
    flat = sym.ravel()
    emits = np.stack([np.bincount(flat, a[:, i].ravel(), len(model.emit)) for i in range(k)], 1)
    return a[0].sum(1, dtype=np.float64), moves * model.move, emits, float(np.log(scale, dtype=np.float64).sum())


def trainer(shared):
    """Sums of expected counts by cell of the model; the cell after the last holds the log-likelihood."""
    schema = pa.schema([("cell", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(STATES + STATES * STATES + model.emit.size + 1)
        held: list[np.ndarray] = []

        def add() -> None:
            held.sort(key=len, reverse=True)
            for part in batched(held):
                total.__iadd__(np.concatenate([np.ravel(x) for x in expected(model, part)]))
            held.clear()

        waiting = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, "<u2"))
                waiting += len(held[-1])
                if waiting >= SYMBOLS:
                    add()
                    waiting = 0
        add()
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 20_000):
            part = cells[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], schema=schema)

    return run


def likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact forward probability of sequences sorted by falling length, in float64."""
    sym, alive = padded(sequences)
    out = np.zeros(len(sequences))
    onward, emit = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    now = model.start[:, None] * emit[:, sym[0]]
    for t in range(len(sym)):
        n = alive[t]
        if t:
            now = onward @ now[:, :n]
            now *= emit.take(sym[t, :n], axis=1)
        c = now.sum(0)
        out[:n] += np.log10(c)
        now /= c
    return out


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_own double, log_class double, path double"
SCORED_ARROW = pa.schema([(f.name, f.type) for f in ROW_ARROW if f.name in ("row", "doc_id", "held_out", "n_tokens", "known", "log_own", "log_class")] + [("path", pa.float64())])


def scorer(shared):
    """path: likelihood of the symbols, less the within-class denominators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, below = shared.value
        held: list[tuple] = []
        symbols = 0

        def done() -> Iterator[tuple]:
            held.sort(key=lambda x: len(x[1]), reverse=True)
            heads = iter(held)
            for part in batched([s for _, s in held]):
                for s, p in zip(part, likelihoods(model, part)):
                    yield (*next(heads)[0], float(p - below[s].sum()))

        def rows() -> Iterator[tuple]:
            nonlocal symbols
            for batch in batches:
                heads = zip(*(batch.column(i).to_pylist() for i in range(7)))
                for head, raw in zip(heads, batch.column(7).to_pylist()):
                    s = np.frombuffer(raw, "<u2")
                    held.append((head, s))
                    symbols += len(s)
                    if symbols >= SYMBOLS:
                        yield from done()
                        held.clear()
                        symbols = 0
            yield from done()

        yield from emitted(rows(), SCORED_ARROW)

    return run


def set_anew(counts: np.ndarray, unigram: np.ndarray) -> Model:
    k = STATES
    start, move, emit = counts[:k] + 1 / k, counts[k : k + k * k].reshape(k, k) + 1 / k, counts[k + k * k :].reshape(-1, k) + PRIOR * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def frequent(vocabulary: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` words have; from a histogram of at most a few thousand bins."""
    wide = F.floor(F.log2("c") * 64).cast("long")
    edge = F.when(F.col("c") <= 1024, F.col("c")).otherwise(F.ceil(F.pow(F.lit(2.0), wide / 64)).cast("long"))
    bins = vocabulary.groupBy(edge.alias("least")).agg(F.count("*").alias("n"))
    least, held = 1 << 62, 0
    for r in sorted(bins.collect(), key=lambda r: -r["least"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least


@dataclass
class Fitted:
    """A trained model and the tables it was trained from."""

    model: Model
    below: np.ndarray  # log10 of the within-class denominators, by symbol
    hot: Words
    tokens: int  # N
    distinct: int  # V
    vocabulary: DataFrame  # word, c
    table: DataFrame  # ROW
    objectives: list[float]  # of each full pass's model before it: log-likelihood with the prior's term


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, apart: int = 1, passes: int = PASSES) -> Fitted:
    """Counts, classes and the model of the texts whose fold isn't ``apart``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    space = Workspace(spark, "hmm")
    ids = docs.select(docs[text_col].alias("text"), docs[id_col].alias("_id"))
    crc = fold("_id", 1 << 30)
    rows = ids.select("text", (fold("_id", folds) == apart).alias("held_out"), F.col("_id").cast("long").alias("doc_id"), ((F.floor(crc / folds)) % 32).cast("int").alias("share"))
    counted = rows.select("text", "held_out").mapInArrow(counter(), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = space.save(counted, "words")
    tail = F.crc32(F.expr("substring(word, -3, 3)")) % CLASSES
    total = vocabulary.where(F.length("word") > 0).groupBy(tail.alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows
    top = vocabulary.where((F.col("c") >= frequent(vocabulary, HOT)) & (F.length("word") > 0)).collect()  # at most HOT words
    ended = next((r["c"] for r in vocabulary.where(F.length("word") == 0).collect()), 0)
    size_n, size_v = np.zeros(OWN + CLASSES), np.zeros(OWN + CLASSES)
    for r in total:
        size_n[OWN + r["class"]], size_v[OWN + r["class"]] = r["n"], r["v"]
    n_all, v_all = int(size_n.sum() + ended), int(size_v.sum() + (ended > 0))
    unigram = np.zeros(OWN + CLASSES)
    unigram[0] = ended
    found = [(END, ended, 0)] if ended else []
    for single, (word, c) in enumerate(sorted(((bytes(r["word"]), r["c"]) for r in top), key=lambda x: (-x[1], x[0])), 1):
        symbol = class_of(word)
        if single < OWN:
            size_n[symbol] -= c
            size_v[symbol] -= 1
            symbol, unigram[single] = single, c
        found.append((word, c, symbol))
    hot = Words([w for w, *_ in found], np.log10(np.array([c for _, c, _ in found], float) + 0.5), np.array([s for *_, s in found], np.int32))
    unigram[OWN:] = size_n[OWN:]
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    below = np.zeros(OWN + CLASSES)
    below[OWN:] = np.log10(size_n[OWN:] + 0.5 * (size_v[OWN:] + 1))
    table = space.save(rows.select("text", "held_out", "doc_id", "share").mapInArrow(encoder(sc.broadcast(hot)), ROW), "rows")

    model, objectives = fresh(unigram), []
    for turn in range(SETTLE + passes):
        part = table.where(~F.col("held_out"))
        if turn < SETTLE:
            part = part.where(F.col("share") == 0)
        sums = part.select("symbols").mapInArrow(trainer(sc.broadcast(model)), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # the model's cells
        if not sums:
            continue  # no texts to learn from
        counts = np.zeros(STATES + STATES * STATES + unigram.size * STATES + 1)
        for r in sums:
            counts[r["cell"]] = r["v"]
        if turn >= SETTLE:
            objectives.append(float(counts[-1] + prior_term(model, unigram)))
        model = set_anew(counts[:-1], unigram)
    return Fitted(model, below, hot, n_all, v_all, vocabulary, table, objectives)


def prior_term(model: Model, unigram: np.ndarray) -> float:
    """Logarithm of the prior's density, of the pseudo-counts of ``set_anew``, up to a constant."""
    return float(PRIOR * (unigram[:, None] * np.log(model.emit)).sum() + np.log(model.move).sum() / STATES + np.log(model.start).sum() / STATES)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, apart: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    return scored(fit(docs, id_col, text_col, folds, apart))


def scored(fitted: Fitted) -> DataFrame:
    """Scores of all rows that the model was fitted with, held-out ones too."""
    table = fitted.table
    shared = table.sparkSession.sparkContext.broadcast((fitted.model, fitted.below))
    rare = table.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    joined = rare.join(fitted.vocabulary, "word", "left").select("row", "tf", F.coalesce("c", F.lit(0)).alias("c"))
    sums = joined.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"))
    paths = table.select("row", "doc_id", "held_out", "n_tokens", "known", "log_own", "log_class", "symbols").mapInArrow(scorer(shared), SCORED)
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    below = float(np.log10(fitted.tokens + 0.5 * (fitted.distinct + 1)))
    return paths.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (F.col("log_own") + F.col("log_class") + log_rare - F.col("n_tokens") * below).alias("base_score"),
        (F.col("path") + F.col("log_class") + log_rare).alias("score"),
    )

"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's words (A-Z lowered; letters and all non-ASCII bytes are kept, the rest separates) give
their byte 2- to 4-grams with word bounds, hashed into buckets. The mean of the buckets'
embeddings goes through a linear softmax. A temperature, fitted on training rows kept apart,
calibrates the probabilities; a text whose best probability is under the rejection bound, or that
has no letter, is rejected. The bound is the ``reject_rate`` quantile of the correct answers among
the rows kept apart, 0.5 at most, so that clean texts stay.

Training takes at most ``per_label`` ids of each label, by a hash of the id, and of an id's rows one text
of each label: the one bounded sample here. A text taught is taught whole, and besides in RUNS random runs
of at most RUN_WORDS of its words, so that short texts are known too. Predictions read whole texts. Null or
letterless texts get ``und``, score 0, rejected; so does everything when there are no labelled rows. Repeated
rows are predicted each; equal texts get equal results. Only the id, text and label columns are read, and
result columns avoid the names of columns that are there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import free, sampled, serving, texts

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: A-Z become a-z; a-z and bytes from 128 stay; all others become a space.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BITS, DIMENSIONS = 15, 16
#: Short examples of each text taught, and their most words.
RUNS, RUN_WORDS = 4, 200
#: Words hashed at once, so that a long text needs no more memory than a short one.
AT_ONCE = 1 << 16
ODD = np.uint32(2654435761)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket -> logits: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    bound: float


def split(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of each 2- to 4-gram that lies in one word and its bounds."""
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    inner = a != 32
    h2 = a[:-1] * np.uint32(769) + a[1:]
    h3 = h2[:-1] * np.uint32(769) + a[2:]
    h4 = h3[:-1] * np.uint32(769) + a[3:]
    m3 = inner[1:-1]
    m4 = m3[:-1] & m3[1:]
    h = np.concatenate([h2, h3[m3] + np.uint32(0x9E3779B9), h4[m4] + np.uint32(0x3C6EF372)])
    return ((h ^ (h >> np.uint32(15))) * ODD) >> np.uint32(32 - BITS)


def mean_logits(model: Model, words: list[bytes]) -> np.ndarray:
    total, count = np.zeros(len(model.labels)), 0
    for at in range(0, len(words), AT_ONCE):
        b = np.bincount(buckets(words[at : at + AT_ONCE]), minlength=1 << BITS)
        total += b @ model.table
        count += int(b.sum())
    return total / max(count, 1) + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shares(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and the share of each."""
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(words), AT_ONCE):
        counts += np.bincount(buckets(words[at : at + AT_ONCE]), minlength=1 << BITS)
    b = np.flatnonzero(counts)
    return b, (counts[b] / counts.sum()).astype(np.float32)


def examples(rows: list[tuple[bytes, int]], rng: np.random.Generator, runs: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, their shares, label) of each whole text and of ``runs`` random runs of 1 to RUN_WORDS words of it."""
    out = []
    for text, label in rows:
        words = split(text)
        if not words:
            continue
        out.append((*shares(words), label))
        for _ in range(runs):
            length = min(len(words), int(np.exp(rng.uniform(0, np.log(RUN_WORDS)))))
            start = int(rng.integers(0, len(words) - length + 1))
            out.append((*shares(words[start : start + length]), label))
    return out


def train(rows: list[tuple[int, bytes, str]], epochs: int = 3, rate: float = 4.0, reject_rate: float = 0.001, seed: int = 7) -> Model:
    """From (id, text, label) rows; a fifth of them, in order of id, are kept apart for calibration."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    labels = sorted({r[2] for r in rows})
    at = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    learn = examples([(t, at[x]) for i, (_, t, x) in enumerate(rows) if i % 5], rng, RUNS)
    apart = examples([(t, at[x]) for i, (_, t, x) in enumerate(rows) if i % 5 == 0], rng, RUNS)
    embed = rng.normal(0, 0.05, (1 << BITS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.3, (DIMENSIONS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            b, share, label = learn[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ embed[b]
            p = softmax(mean @ weights + bias)
            p[label] -= 1
            back = weights @ p
            weights -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.02 * p
            embed[b] -= lr * share[:, None] * back
    table = (embed @ weights).astype(np.float64)
    model = Model(labels, table, bias.astype(np.float64), 1.0, 0.5)
    if apart and len(labels) > 1:
        z = np.array([share @ table[b] + model.bias for b, share, _ in apart])
        y = np.array([label for *_, label in apart])
        ts = np.geomspace(0.1, 10, 61)
        losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in ts]
        model.temperature = float(ts[int(np.argmin(losses))])
        p = softmax(z / model.temperature)
        right = p.argmax(1) == y
        model.bound = float(min(0.5, np.quantile(p[right].max(1), reject_rate))) if right.any() else 0.0
    return model


def predict(model: Model, text: bytes) -> tuple[str, float, bool]:
    """(label, calibrated probability, rejected) of a whole text."""
    if not model.labels or not LETTER.search(text.decode("utf-8", "replace")):
        return UNKNOWN, 0.0, True
    p = softmax(mean_logits(model, split(text)) / model.temperature)
    best = int(p.argmax())
    return model.labels[best], float(p[best]), bool(p[best] < model.bound)


def sample(docs: DataFrame, learnable: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[int, bytes, str]]:
    """(id, text, label) of at most ``per_label`` ids of each label; one text of an id's rows with the same label."""
    rows = docs.where(learnable & docs[label_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("_id"), docs[label_col].alias("_label"), docs[text_col].alias("_text"))
    chosen = sampled(rows, per_label, "_label")
    if not chosen:
        return []
    kinds = f"_id {rows.schema['_id'].dataType.simpleString()}, _label {rows.schema['_label'].dataType.simpleString()}"
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, kinds))
    taught = rows.join(few, ["_id", "_label"]).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return [(r["_id"], r["_text"].encode(), r["_label"]) for r in taught.collect()]


def fit(docs: DataFrame, learnable: Column, per_label: int = 600, **columns: str) -> Model:
    return train(sample(docs, learnable, per_label, **columns))


NAMES = ("_lang", "_score", "_rejected")


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] | None = None) -> DataFrame:
    """``docs`` with label string, probability double and rejected boolean; ``names`` of these, else NAMES made free."""
    names = names or free(docs.columns, *NAMES)
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType())))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("langid")
        for batch in batches:
            got = [predict(shared.value, t) for t in texts(batch, text_col)]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)

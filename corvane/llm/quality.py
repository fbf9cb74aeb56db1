"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: a logistic model of its text's shape and the strongest log-odds of its words
and word beginnings for the ``toxic`` label, both fitted in numpy on at most ``sample`` labelled rows
by a hash of the id. Sites: the evidence of all documents is summed by host and by path (host and a
second column) in grouped sums. A host's mean shrinks toward the global mean, a path's toward its
host's, with as many pseudo-documents as the spread between the groups suggests, so that sparse sites
stay near their priors. The posterior adds the document's log-odds and the site's shift.

Null and empty texts have quality 0 evidence and no toxic words; null host or path is a group of its
own. Without labels all evidence is 0.5. Repeated rows are judged each; only the named columns are read.
In ``documents`` the host is the source and the path the language, the finest site that table names. A
document's own evidence is left out of the means of its host and path, so that it counts once; the global
mean is of all. Labels without an id are left out; of an id's rows one text is learned from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, sampled, texts

#: Letters of word beginnings that are features of their own.
STEMS = (3, 4, 5)
#: Letters, or bytes from 128, as they are: the rest separates words.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UPPER, DIGIT, ODD = (bytes(c for c in range(256) if c not in kind) for kind in (range(65, 91), range(48, 58), b"%#$&*|!<>{}[]=_~^\\/@"))
CACHED = 300_000


def shape(text: bytes) -> np.ndarray:
    """Counts and shares that don't depend on the language."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    upper, digit, odd = (len(text.translate(None, kind)) / size for kind in (UPPER, DIGIT, ODD))
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    ends = sum(text.count(x) for x in (b".", b",", b"\n"))
    return np.array([1.0, np.log1p(len(words)) / 5, len(counts) / n, (len(counts) / n) * np.log1p(len(words)) / 5, top / n, upper * 5, digit * 10, odd * 10, repeated, ends / n, size / n / 10, len(lines) / n * 5, float(not words)])


def features(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    odds: dict[bytes, float]
    toxic_bound: float


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[bytes, int | None, int | None]]) -> Model:
    """From (text, quality, toxic) rows."""
    x = np.array([shape(t) for t, q, _ in rows if q is not None]) if rows else np.empty((0, 13))
    y = np.array([q for _, q, _ in rows if q is not None], float)
    mean = x.mean(0) if len(x) else np.zeros(13)
    deviation = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(13)
    mean[0], deviation[0] = 0.0, 1.0
    # squares let both ends of a share count
    weights = logistic(wide((x - mean) / deviation), y) if len(set(y.tolist())) == 2 else np.zeros(25)
    bad, good = Counter(), Counter()
    n_bad = n_good = 0
    for text, _, toxic in rows:
        if toxic is None:
            continue
        found = {f for w in set(text.translate(KEPT).split()) for f in features(w)}
        (bad if toxic else good).update(found)
        n_bad, n_good = n_bad + bool(toxic), n_good + (not toxic)
    # a feature must stand in several toxic texts and hardly in others
    odds = {f: float(np.log((c + 0.1) / (n_bad + 1)) - np.log((good[f] + 0.1) / (n_good + 1))) for f, c in bad.items() if c >= 3}
    odds = {f: v for f, v in odds.items() if v > 2}
    return Model(weights, mean, deviation, odds, best_bound(rows, odds))


def wide(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.minimum(x[..., 1:] ** 2, 25)], axis=-1)


def best_bound(rows: list[tuple], odds: dict[bytes, float]) -> float:
    """The bound on the strongest log-odds of the best F1 on the sample."""
    scored = [(max((odds.get(f, 0.0) for w in set(t.translate(KEPT).split()) for f in features(w)), default=0.0), toxic) for t, _, toxic in rows if toxic is not None]
    best, bound = 0.0, float("inf")
    for cut in sorted({round(s, 2) for s, toxic in scored if toxic and s > 0}):
        hit = sum(1 for s, t in scored if t and s >= cut)
        f1 = 2 * hit / (sum(1 for s, _ in scored if s >= cut) + sum(1 for _, t in scored if t))
        if f1 > best:
            best, bound = f1, cut
    return bound


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """doc_id, host, path, p (of good shape), toxicity, and toxic, for each row."""
    names = ["doc_id", "host", "path", "p", "toxicity"]
    chosen = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("doc_id"), docs[host_col].cast("string").alias("host"), docs[path_col].cast("string").alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        odds, known = m.odds, {}
        for batch in batches:
            ps, ts = [], []
            for text in texts(batch):
                z = float(wide((shape(text) - m.mean) / m.deviation) @ m.weights)
                ps.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if text.strip() else 0.0 if m.weights.any() else 0.5)
                best = 0.0
                for word in set(text.translate(KEPT).split()):
                    if (v := known.get(word)) is None:
                        if len(known) > CACHED:
                            known.clear()
                        v = known[word] = max(odds.get(f, 0.0) for f in features(word))
                    if v > best:
                        best = v
                ts.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ps, pa.float64()), pa.array(ts, pa.float64())], names=names)

    return chosen.mapInArrow(run, "doc_id long, host string, path string, p double, toxicity double").withColumn("toxic", F.col("toxicity") >= model.toxic_bound)


def strength(groups: DataFrame, prior: str) -> float:
    """Pseudo-documents of the prior of groups (n, s, s2), from their spread by the method of moments."""
    m = groups.agg(F.sum("n"), F.sum("s"), F.sum("s2"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(prior), 2)), F.count("*")).first()
    n, s, s2, spread, count = (float(x or 0) for x in m)
    within = max(s2 / n - (s / n) ** 2, 1e-6) if n else 1.0
    between = max((spread - count * within) / n, 1e-6) if n else 1.0
    return min(within / between, 1e6)


def mean(s: Column, n: Column, k: float, prior: Column) -> Column:
    """The mean of a group shrunk toward its prior."""
    return (s + k * prior) / (n + k)


def taught(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> list[tuple[bytes, int | None, int | None]]:
    """(text, quality, toxic) of at most ``sample`` labelled ids, in order of id."""
    told = labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").where("_id is not null")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    chosen = sampled(told, sample)
    if not chosen:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i, _ in chosen], f"_id {told.schema['_id'].dataType.simpleString()}"))
    told = told.join(few, "_id").groupBy("_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = rows.join(few, "_id").groupBy("_id").agg(F.min("_text").alias("_text")).join(told, "_id").collect()
    return [((r["_text"] or "").encode(), r["quality"], r["toxic"]) for r in sorted(found, key=lambda r: r["_id"])]


def judge(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, evidence, toxicity, toxic, host_mean, path_mean, posterior, keep for every row."""
    space = Workspace(docs.sparkSession, "quality")
    model = fit(taught(docs, labels, sample, id_col, text_col))
    return posteriors(space.save(evidence(docs, model, id_col, text_col, host_col, path_col), "evidence"), space)


def posteriors(found: DataFrame, space: Workspace) -> DataFrame:
    """Sites, posterior and decision for rows of ``evidence``."""
    paths = found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    paths = space.save(paths, "paths")
    top = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    top = 0.5 if top is None else float(top)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).withColumn("_prior", F.lit(top))
    host_k = strength(hosts, "_prior")
    hosts = hosts.select(F.col("host").alias("_host"), F.col("n").alias("_hn"), F.col("s").alias("_hs"))
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["_host"])).withColumn("_prior", mean(F.col("_hs"), F.col("_hn"), host_k, F.lit(top)))
    path_k = strength(sites, "_prior")
    sites = space.save(sites.select("_host", F.col("path").alias("_path"), "_hn", "_hs", F.col("n").alias("_pn"), F.col("s").alias("_ps")), "sites")
    small = F.broadcast(sites) if sites.count() <= 100_000 else sites
    out = found.join(small, found["host"].eqNullSafe(small["_host"]) & found["path"].eqNullSafe(small["_path"]), "left")
    # the document itself is left out of both
    out = out.withColumn("host_mean", mean(F.col("_hs") - F.col("p"), F.col("_hn") - 1, host_k, F.lit(top)))
    out = out.withColumn("path_mean", mean(F.col("_ps") - F.col("p"), F.col("_pn") - 1, path_k, F.col("host_mean")))

    def logit(c: str) -> Column:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
        return F.log(p / (1 - p))

    shift = logit("path_mean") - float(np.log(max(top, 1e-6) / max(1 - top, 1e-6)))
    posterior = 1 / (1 + F.exp(-(logit("p") + shift)))
    return out.withColumn("posterior", posterior).select("doc_id", F.col("p").alias("evidence"), "toxicity", "toxic", "host_mean", "path_mean", "posterior", ((F.col("posterior") >= 0.5) & ~F.col("toxic")).alias("keep"))

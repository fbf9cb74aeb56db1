"""Queries of metrics, over deterministic predictors on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import metrics, ranking, vectorindex

from .retrieval import BM25, DOT, bm25_topk, items, knn
from .tables import TOKENS, table


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with guesses from the text: long ones are good, ones of many exclamation marks toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("long"), F.length(F.regexp_replace("text", "[^!]", "")).alias("marks"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.withColumn("p_quality", F.least(F.lit(1.0), F.col("long") / 3000.0)).withColumn("p_toxic", F.least(F.lit(1.0), (F.col("doc_id") % 10) / 10.0))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    pair = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("actual"), F.col(f"p_{c}").alias("p")) for c in ("quality", "toxic")])
    return rows.select("doc_id", F.explode(pair).alias("c")).select("doc_id", "c.*")


def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of a benchmark item: the documents that hold its whole text.

    A document that holds an item holds the item's longest inner word, so the two meet by that word; an item
    of fewer than three words has none and is held against all.
    """
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), text.tokens(F.col("text")).alias("_t"))
    inner = F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = bench.select("query_id", "item", longest.alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    met = docs.select("doc_id", "text", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("key")).join(ranking.sent(keyed.where("key is not null")), "key")
    short = docs.crossJoin(ranking.sent(keyed.where("key is null"))).select("doc_id", "text", "query_id", "item")
    gold = met.select("doc_id", "text", "query_id", "item").unionAll(short).where(F.contains("text", "item")).select("query_id", F.col("doc_id").alias("item_id"))
    every = bench.select("query_id").join(gold, "query_id", "left")
    ranked = bm25_topk(spark, sf_dir, 10).withColumnRenamed("doc_id", "item_id")
    return metrics.target_ranks(ranked, every)


def hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_and_mrr(gold_ranks(spark, sf_dir), 10)


def class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first neighbour of a query's own class; recall over the classes that the index holds."""
    q = items(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding", F.col("label").alias("own"))
    near = ranking.nearest(q.select("query_id", "embedding"), items(spark, sf_dir), 10).where("item_id != query_id")
    labelled = near.join(items(spark, sf_dir).select("item_id", "label"), "item_id").join(q.select("query_id", "own"), "query_id")
    first = labelled.where("label = own").groupBy("query_id").agg(F.min("rank").alias("rank"))
    ranks = q.select("query_id", "own").join(first, "query_id", "left")
    gold = q.select("query_id", F.col("own").alias("item_id"))
    index = items(spark, sf_dir).select(F.col("label").alias("item_id"))
    return metrics.recall_of_evaluable(ranks, gold, index, 5)


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's answers against its questions."""
    turns = table(spark, sf_dir, "conversations")
    side = lambda r: F.flatten(F.collect_list(F.when(F.col("role") == r, text.tokens(F.col("text")))))
    pairs = turns.groupBy("conv_id").agg(side("assistant").alias("a"), side("user").alias("b"))
    return metrics.token_overlap(pairs, "conv_id", F.col("a"), F.col("b"))


def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multilabel(cells(spark, sf_dir).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), "doc_id", "label", "actual", "predicted")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_search(cells(spark, sf_dir), "label", "actual", "p")


def binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("t", F.lit(0.75))
    return metrics.binarised(rows, "doc_id", "label", "p", "t").select("doc_id", "label", "predicted")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predicted(spark, sf_dir).withColumn("guess", (F.col("p_quality") >= 0.5).cast("int")), "quality", "guess")


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(predicted(spark, sf_dir).withColumn("guess", (F.col("p_quality") >= 0.5).cast("int")), "quality", "guess")


def percentiles3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


def mean_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def pivot_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each user's event types by count, in columns."""
    kinds = ["click", "view", "purchase", "signup", "error"]
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))
    return ranked.groupBy("user_id").pivot("event_type", kinds).agg(F.first("rank"))


def label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in at least two documents, with how many do."""
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    return docs.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hash_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 0.1, 7)


def support_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class, the share of its queries whose best other vector is at least 0.52 near."""
    asked = items(spark, sf_dir).where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    found = vectorindex.largest(asked, items(spark, sf_dir), vectorindex.products, itself=False).select("query_id", F.round("best", 6).alias("best"))
    best = asked.select("query_id", F.col("label").alias("own")).distinct().join(found, "query_id", "left")
    return best.groupBy("own").agg(F.round(F.avg(F.when(F.col("best") >= 0.52, 1.0).otherwise(0.0)), 6).alias("support"), F.count("*").alias("units"))


PRED = "pred AS (SELECT doc_id, quality, toxic, least(1.0, length(text) / 3000.0) AS p_quality, least(1.0, (doc_id % 10) / 10.0) AS p_toxic FROM labels JOIN documents USING (doc_id))"
CELLS = f"{PRED}, cells AS (SELECT doc_id, 'quality' AS label, quality AS actual, p_quality::DOUBLE AS p FROM pred UNION ALL SELECT doc_id, 'toxic', toxic, p_toxic::DOUBLE FROM pred)"
MULTI = f"{CELLS}, m AS (SELECT doc_id, label, actual * pr AS tp, pr * (1 - actual) AS fp, actual * (1 - pr) AS fn FROM (SELECT *, (p >= 0.5)::INT AS pr FROM cells))"
F1 = "CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END"
KINDS = ["click", "view", "purchase", "signup", "error"]
ORACLE_SQL = {
    "hit_mrr": f"""WITH {BM25}, gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)), r AS (SELECT g.query_id, min(s.rank) AS rank FROM gold g LEFT JOIN (SELECT * FROM sparse WHERE rank <= 10) s ON s.query_id = g.query_id AND s.doc_id = g.doc_id GROUP BY 1)
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_at_k, round(avg(rank), 6) AS mean_rank, count(*) AS queries FROM r""",
    "class_recall": f"""WITH n AS ({knn(DOT, 10)}), f AS (SELECT n.query_id, min(rank) AS rank FROM n JOIN embeddings a ON a.vec_id = n.item_id JOIN embeddings b ON b.vec_id = n.query_id WHERE item_id <> query_id AND a.label = b.label GROUP BY 1)
SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS evaluable FROM embeddings e LEFT JOIN f ON f.query_id = e.vec_id WHERE vec_id % 100 = 0""",
    "token_f1": f"""WITH t AS (SELECT conv_id, role, unnest({TOKENS}) AS t FROM conversations), a AS (SELECT conv_id, t, count(*) FILTER (role = 'assistant') AS x, count(*) FILTER (role = 'user') AS y FROM t GROUP BY 1, 2),
s AS (SELECT conv_id, sum(least(x, y)) AS s, sum(x) AS na, sum(y) AS nb FROM a GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id, CASE WHEN na > 0 THEN s / na ELSE 0 END AS p, CASE WHEN nb > 0 THEN s / nb ELSE 0 END AS r FROM c LEFT JOIN s USING (conv_id))
SELECT conv_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""",
    "multilabel_metrics": f"""WITH {MULTI} SELECT round(micro_p, 6) AS micro_p, round(micro_r, 6) AS micro_r, round(micro_f1, 6) AS micro_f1, round(hamming, 6) AS hamming, round(macro_f1, 6) AS macro_f1, round(samples_f1, 6) AS samples_f1, round(jaccard, 6) AS jaccard, round(exact_match, 6) AS exact_match FROM
(SELECT sum(tp) / (sum(tp) + sum(fp)) AS micro_p, sum(tp) / (sum(tp) + sum(fn)) AS micro_r, {F1} AS micro_f1, avg(fp + fn) AS hamming FROM m), (SELECT avg(f) AS macro_f1 FROM (SELECT {F1} AS f FROM m GROUP BY label)),
(SELECT avg(f) AS samples_f1, avg(j) AS jaccard, avg(e) AS exact_match FROM (SELECT {F1} AS f, CASE WHEN sum(tp) + sum(fp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fp) + sum(fn)) ELSE 0 END AS j, CASE WHEN sum(fp) + sum(fn) = 0 THEN 1.0 ELSE 0.0 END AS e FROM m GROUP BY doc_id))""",
    "threshold_grid": f"""WITH {CELLS}, g AS (SELECT round(0.15 + i * 0.05, 10) AS threshold FROM range(13) r(i)), s AS (SELECT label, threshold, sum(CASE WHEN p >= threshold THEN actual ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN 1 ELSE 0 END) AS called, sum(actual) AS real FROM cells, g GROUP BY 1, 2)
SELECT label, threshold::DOUBLE AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS n FROM (SELECT label, threshold, round(CASE WHEN called + real > 0 THEN 2 * tp / (called + real) ELSE 0 END, 6) AS f1 FROM s)) WHERE n = 1""",
    "binarise": f"WITH {CELLS} SELECT doc_id, label, CASE WHEN max(p) OVER (PARTITION BY doc_id) >= 0.75 THEN (p >= 0.75)::INT ELSE (row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) = 1)::INT END AS predicted FROM cells",
    "confusion": f"WITH {PRED} SELECT quality, (p_quality >= 0.5)::INT AS guess, count(*) AS n FROM pred GROUP BY 1, 2",
    "label_accuracy": f"WITH {PRED} SELECT round(avg(CASE WHEN quality = (p_quality >= 0.5)::INT THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred",
    "percentiles3": "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS linear, max(value) FILTER (r = greatest(1, ceil(0.95 * n))) AS nearest_rank, max(value) FILTER (r = round_even((n - 1) * 0.95, 0) + 1) AS rounded_index FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "mean_and_median": "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1",
    "pivot_ranks": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) SELECT user_id, {', '.join(f'max(rank) FILTER (event_type = {chr(39)}{k}{chr(39)}) AS {chr(34)}{k}{chr(34)}' for k in KINDS)} FROM r GROUP BY 1",
    "label_support": f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS})) AS word FROM documents) WHERE word IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "seeded_split": "SELECT doc_id, quality, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) <= (SELECT greatest(1, round(count(*) * 0.1)) FROM labels) AS valid FROM labels",
    "support_ratio": f"SELECT own, round(avg(CASE WHEN best >= 0.52 THEN 1.0 ELSE 0.0 END), 6) AS support, count(*) AS units FROM (SELECT b.vec_id, b.label AS own, round(max({DOT}), 6) AS best FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2) GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}

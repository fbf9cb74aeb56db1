"""Queries of search: vectors, BM25, fusion, caps and budgets. Query sets are stated: every benchmark item, or ids divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text, vectors
from corvane.operators import ranking, vectorindex

from .tables import TOKENS, table

WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")


def knn_ip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest(asked(spark, sf_dir), items(spark, sf_dir), 10)


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest(asked(spark, sf_dir), items(spark, sf_dir), 10, "l2")


def knn_cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest(asked(spark, sf_dir), items(spark, sf_dir), 5, "cosine", where=F.col("label") == 3)


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ranking.nearest(asked(spark, sf_dir), items(spark, sf_dir), 20)
    return near.join(items(spark, sf_dir).where("label = 3").select("item_id"), "item_id", "left_semi").select("query_id", "item_id", "score", "rank")


def knn_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|d² - (2 - 2 cos)| of unit vectors, the largest over all pairs of a query and an item."""
    error = vectorindex.largest(asked(spark, sf_dir), items(spark, sf_dir), vectorindex.gaps)
    sizes = asked(spark, sf_dir).groupBy("query_id").agg((F.count("*") * F.lit(items(spark, sf_dir).count())).alias("pairs"))
    return sizes.join(error, "query_id", "left").select("query_id", (F.col("best") < 1e-5).alias("identical"), "pairs")


def intent_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity per class of each query to all other rows; under 0.5 the class is null."""
    best = vectorindex.largest(asked(spark, sf_dir), items(spark, sf_dir), vectorindex.cosines, "label", itself=False).withColumn("score", F.round("best", 6))
    top = ranking.top_k(best, ["query_id"], [F.desc("score"), F.asc("label")], 1)
    every = asked(spark, sf_dir).select("query_id").distinct().join(top, "query_id", "left")
    return every.select("query_id", F.when(F.col("score") >= 0.5, F.col("label")).alias("intent"), "score")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = items(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))  # one entry per dimension
    return gathered.select("label", vectors.unit(F.transform("v", lambda x: x["m"])).alias("centroid"))


def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = items(spark, sf_dir).select("item_id", "embedding").crossJoin(ranking.sent(centroids(spark, sf_dir)))
    scored = pairs.select("item_id", "label", F.round(vectors.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    return ranking.top_k(scored, ["item_id"], [F.desc("score"), F.asc("label")], 1).drop("rank")


def centroid_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = items(spark, sf_dir).join(F.broadcast(centroids(spark, sf_dir)), "label")  # one row per class
    scored = pairs.select("label", "item_id", F.round(vectors.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    return ranking.top_k(scored, ["label"], [F.desc("score"), F.asc("item_id")], 3)


def bm25_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return ranking.bm25(docs, queries, text.tokens(F.col("text")), text.tokens(F.col("q")), k)


def dense_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Query i stands for vector i: the vectors of the benchmark's ids against all."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "embedding").join(ids, "query_id", "left_semi")
    return ranking.nearest(queries, items(spark, sf_dir), k)


def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = bm25_topk(spark, sf_dir, 20).withColumnRenamed("doc_id", "item_id")
    return ranking.fuse([(dense_topk(spark, sf_dir, 20), 0.55), (sparse, 0.45)], 10)


def rrf_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = bm25_topk(spark, sf_dir, 20).withColumnRenamed("doc_id", "item_id")
    return ranking.fuse([(dense_topk(spark, sf_dir, 20), 1.0), (sparse, 1.0)], 10)


def minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores scaled to 0..1 per query and blended 0.6 to 0.4; a missing one counts 0."""
    d = dense_topk(spark, sf_dir, 20).withColumn("d", ranking.min_max("score", ["query_id"])).select("query_id", "item_id", "d")
    s = bm25_topk(spark, sf_dir, 20).withColumn("s", ranking.min_max("score", ["query_id"])).select("query_id", F.col("doc_id").alias("item_id"), "s")
    both = d.join(s, ["query_id", "item_id"], "full_outer")
    score = F.round(0.6 * F.coalesce("d", F.lit(0.0)) + 0.4 * F.coalesce("s", F.lit(0.0)), 6)
    return ranking.top_k(both.select("query_id", "item_id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("item_id")], 10)


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("long"))
    return bm25_topk(spark, sf_dir, 30).join(docs, "doc_id")


def per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped(ranked_documents(spark, sf_dir), ["query_id"], [F.asc("rank")], ["source"], 2, 10).select("query_id", "doc_id", "source", "rank", "position")


def parent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_of_group(ranked_documents(spark, sf_dir), ["query_id", "source"], [F.asc("rank")]).select("query_id", "source", "doc_id", "rank")


def context_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.within_budget(ranked_documents(spark, sf_dir), ["query_id"], [F.asc("rank")], "long", 6000).select("query_id", "doc_id", "rank", "used")


def context_budget_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.within_budget(ranked_documents(spark, sf_dir), ["query_id"], [F.asc("rank")], "long", 2000, first_always=True).select("query_id", "doc_id", "rank", "used")


def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gated(bm25_topk(spark, sf_dir, 30), ["query_id"], "score", 100.0)


def relative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.near_best(bm25_topk(spark, sf_dir, 30), ["query_id"], "score", 5.0, 10.0)


def anchored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense_topk(spark, sf_dir, 20).select("query_id", "item_id", F.col("rank").alias("dense_rank"))
    fused = hybrid_rrf_topk(spark, sf_dir).select("query_id", "item_id", F.col("rank").alias("fused_rank"))
    both = d.join(fused, ["query_id", "item_id"], "full_outer")
    return ranking.anchored(both, ["query_id"], "dense_rank", "fused_rank", "item_id", 3)


def dynamic_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k rises with the words of the query: 5, 8 from 30 words, 10 from 60."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.size(text.tokens(F.col("text"))).alias("n"))
    k = F.when(F.col("n") >= 60, 10).when(F.col("n") >= 30, 8).otherwise(5)
    return bm25_topk(spark, sf_dir, 10).join(words.withColumn("k", k), "query_id").where("rank <= k").select("query_id", "doc_id", "rank", "k")


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2, ... for the best document of each source in rank order."""
    best = parent_dedup(spark, sf_dir)
    return best.select("query_id", "doc_id", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("string")).alias("label"))


def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their source with a query's best three, by how many of those sources' seeds they share."""
    ranked = ranked_documents(spark, sf_dir)
    seeds = ranked.where("rank <= 3").select("query_id", F.col("doc_id").alias("seed"), "source")
    hits = ranked.where("rank > 3").join(seeds, ["query_id", "source"])
    counted = hits.groupBy("query_id", "doc_id").agg(F.count_distinct("seed").alias("seeds"))
    return ranking.top_k(counted, ["query_id"], [F.desc("seeds"), F.asc("doc_id")], 5)


BM25 = f"""
dt AS (SELECT doc_id, {TOKENS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM dt) GROUP BY 1, 2),
raw_idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), stats),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_idf) ELSE idf END AS idf FROM raw_idf),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), stats GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
L2 = "list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))"
COS = f"({DOT}) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
DENSE = f"""
dense AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT b.vec_id AS query_id, a.vec_id AS item_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)))"""


def knn(score: str, k: int, order: str = "DESC", where: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, item_id) AS rank FROM (
  SELECT b.vec_id AS query_id, a.vec_id AS item_id, round({score}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


def rrf(dense: float, sparse: float) -> str:
    return f"""fused AS (SELECT query_id, item_id, round(sum(part), 8) AS rrf_score FROM (
  SELECT query_id, item_id, {dense} / (60 + rank) AS part FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, {sparse} / (60 + rank) FROM sparse WHERE rank <= 20) GROUP BY 1, 2),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS rank FROM fused) WHERE rank <= 10)"""


RANKED = "ranked AS (SELECT s.*, source, lang, length(text) AS long FROM sparse s JOIN documents USING (doc_id) WHERE rank <= 30)"
CENTROIDS = """parts AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
means AS (SELECT label, list(m ORDER BY i) AS v FROM parts GROUP BY 1),
centroids AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS embedding FROM means)"""
MINMAX = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END"

ORACLE_SQL = {
    "knn_ip_topk": knn(DOT, 10),
    "knn_l2_topk": knn(f"sqrt({L2})", 10, "ASC"),
    "knn_cosine_filtered": knn(COS, 5, where="a.label = 3"),
    "knn_postfilter": f"SELECT k.* FROM ({knn(DOT, 20)}) k JOIN embeddings e ON e.vec_id = k.item_id WHERE e.label = 3",
    "knn_identity_check": f"SELECT b.vec_id AS query_id, max(abs({L2} - (2 - 2 * {COS}))) < 1e-5 AS identical, count(*) AS pairs FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 GROUP BY 1",
    "intent_maxsim": f"""SELECT query_id, CASE WHEN score >= 0.5 THEN label END AS intent, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM (
  SELECT b.vec_id AS query_id, a.label, round(max({COS}), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2)) WHERE n = 1""",
    "centroid_classify": f"WITH {CENTROIDS} SELECT item_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) AS n FROM (SELECT a.vec_id AS item_id, b.label, round({DOT}, 6) AS score FROM embeddings a, centroids b)) WHERE n = 1",
    "centroid_topn": f"WITH {CENTROIDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, item_id) AS rank FROM (SELECT b.label, a.vec_id AS item_id, round({DOT}, 6) AS score FROM embeddings a JOIN centroids b USING (label))) WHERE rank <= 3",
    "bm25_topk": f"WITH {BM25} SELECT * FROM sparse WHERE rank <= 10",
    "dense_topk": f"WITH {DENSE} SELECT * FROM dense WHERE rank <= 10",
    "hybrid_rrf_topk": f"WITH {BM25}, {DENSE}, {rrf(0.55, 0.45)} SELECT * FROM rrf",
    "rrf_unweighted": f"WITH {BM25}, {DENSE}, {rrf(1.0, 1.0)} SELECT * FROM rrf",
    "minmax_blend": f"""WITH {BM25}, {DENSE}, d AS (SELECT query_id, item_id, {MINMAX} AS d FROM dense WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)), s AS (SELECT query_id, doc_id AS item_id, {MINMAX} AS s FROM sparse WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, item_id, round(0.6 * coalesce(d, 0) + 0.4 * coalesce(s, 0), 6) AS score FROM d FULL JOIN s USING (query_id, item_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM b) WHERE rank <= 10""",
    "per_group_cap": f"WITH {BM25}, {RANKED} SELECT query_id, doc_id, source, rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM ranked) WHERE n <= 2) WHERE position <= 10",
    "parent_dedup": f"WITH {BM25}, {RANKED} SELECT query_id, source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM ranked) WHERE n = 1",
    "context_budget_stop": f"WITH {BM25}, {RANKED} SELECT query_id, doc_id, rank, used::BIGINT AS used FROM (SELECT *, sum(long) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked) WHERE used <= 6000",
    "context_budget_first": f"WITH {BM25}, {RANKED} SELECT query_id, doc_id, rank, least(used, 2000)::BIGINT AS used FROM (SELECT *, sum(long) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked) WHERE used <= 2000 OR rank = 1",
    "score_gate": f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sparse WHERE rank <= 30) WHERE best >= 100",
    "relative_threshold": f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sparse WHERE rank <= 30) WHERE score >= greatest(5.0, best - 10.0)",
    "anchored_order": f"""WITH {BM25}, {DENSE}, {rrf(0.55, 0.45)} SELECT query_id, item_id, d.rank AS dense_rank, r.rank AS fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN d.rank <= 3 THEN d.rank END NULLS LAST, r.rank NULLS LAST, item_id) AS position
FROM (SELECT * FROM dense WHERE rank <= 20) d FULL JOIN rrf r USING (query_id, item_id)""",
    "dynamic_k": f"WITH {BM25} SELECT query_id, doc_id, rank, k FROM sparse JOIN (SELECT item_id AS query_id, CASE WHEN len({TOKENS}) >= 60 THEN 10 WHEN len({TOKENS}) >= 30 THEN 8 ELSE 5 END AS k FROM benchmark) USING (query_id) WHERE rank <= k",
    "citation_labels": f"WITH {BM25}, {RANKED} SELECT query_id, doc_id, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM ranked) WHERE n = 1",
    "shared_terms": f"""WITH {BM25}, {RANKED}, hits AS (SELECT r.query_id, r.doc_id, count(DISTINCT s.doc_id) AS seeds FROM ranked r JOIN ranked s ON r.query_id = s.query_id AND r.source = s.source AND s.rank <= 3 WHERE r.rank > 3 GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seeds DESC, doc_id) AS rank FROM hits) WHERE rank <= 5""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}

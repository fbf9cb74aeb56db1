"""Queries of catalogue search over part, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import catalog, ranking

from .tables import PRODUCTS, products, table


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with sales: score (lines sold), rating (mean quantity), updated (last ship date), in_stock."""
    line = table(spark, sf_dir, "lineitem")
    sold = line.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("score"), F.round(F.avg("l_quantity"), 4).alias("rating"), F.max("l_shipdate").alias("updated"))
    return products(spark, sf_dir).join(sold, "id", "left").withColumn("in_stock", F.when(F.col("score").isNotNull(), F.col("score") % 3 != 0))


WHERE = {"category_prefix": ["STANDARD"], "excluded": ["Brand#11"], "low": 950.0, "high": 1900.0, "high_inclusive": False}


def product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = catalog.matches(**WHERE, in_stock=True, groups=[["a", "e"], ["i", "o"]])
    return rated(spark, sf_dir).where(wanted).select("id", "brand", "price")


def sorted_by(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = ranking.top_k(rated(spark, sf_dir).where(catalog.matches(**WHERE)), ["brand"], catalog.order_by(mode), 5)
        return best.select("brand", "id", "rank")

    query.__name__ = f"sort_{mode}"
    return query


def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).where(catalog.matches(category_prefix=["standard", "ring"])).select("id", "kind")


def category_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(products(spark, sf_dir), ["STANDARD"])


def root_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(products(spark, sf_dir), [])


def brand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_values(products(spark, sf_dir), "brand", "id")


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    share = catalog.discount(price, F.col("l_extendedprice"))
    return line.groupBy("l_returnflag").agg(F.round(F.avg(share), 6).alias("discount"), F.count("*").alias("n"))


def cheaper_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products under the cheapest of the three best sold of their brand."""
    shown = ranking.top_k(rated(spark, sf_dir), ["brand"], catalog.order_by("relevance"), 3)
    return catalog.cheaper(products(spark, sf_dir), shown.select("brand", "price"), ["brand"]).select("id", "brand", "price")


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = products(spark, sf_dir).where("id % 100 = 0").select("id")
    return catalog.alternatives(products(spark, sf_dir), chosen, "kind", 3)


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = catalog.recommended(rated(spark, sf_dir), ["brand"], catalog.order_by("relevance"), 5, seed=17)
    return best.select("brand", "id", "rank")


def snapshot_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the priority of urgent ones unknown take it from the earlier snapshot."""
    previous = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    current = previous.withColumn("o_orderpriority", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority"))).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    return catalog.carried_forward(current, previous, "o_orderkey", ["o_orderpriority"])


def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    retry = o.where("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("F")).unionAll(o.where("o_orderstatus = 'P'").select(F.col("o_orderkey") + 100_000_000, F.lit("N")))
    return catalog.retried(o, retry, "o_orderkey")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a refresh: share of finished orders and of customers kept, and whether both suffice."""
    o = table(spark, sf_dir, "orders").agg(F.avg(F.when(F.col("o_orderstatus") != "P", 1.0).otherwise(0.0)).alias("success"), F.count_distinct("o_custkey").alias("kept"))
    c = table(spark, sf_dir, "customer").agg(F.count("*").alias("known"))
    both = o.crossJoin(F.broadcast(c))  # one row each
    return both.select(F.round("success", 6).alias("success"), F.round(F.col("kept") / F.col("known"), 6).alias("retention"), ((F.col("success") >= 0.6) & (F.col("kept") / F.col("known") >= 0.5)).alias("passes"))


def composite_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return catalog.first_wins(p, [F.col("brand"), F.col("size"), F.to_json("path")], [F.asc("id")]).select("id", "brand", "size")


def type_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by brand and size class in columns."""
    size = F.when(F.col("size") <= 10, "small").when(F.col("size") <= 30, "middle").otherwise("large")
    return products(spark, sf_dir).withColumn("class", size).groupBy("brand").pivot("class", ["small", "middle", "large"]).agg(F.count("id")).na.fill(0)


RATED = f"{PRODUCTS}, rated AS (SELECT p.*, score, rating, updated, CASE WHEN score IS NOT NULL THEN score % 3 <> 0 END AS in_stock FROM products p LEFT JOIN (SELECT l_partkey AS id, count(*) AS score, round(avg(l_quantity), 4) AS rating, max(l_shipdate) AS updated FROM lineitem GROUP BY 1) USING (id))"
MATCH = "lower(path[1]) = 'standard' AND lower(brand) <> 'brand#11' AND price >= 950 AND price < 1900"
HEADS = {"relevance": "score DESC NULLS LAST", "price_asc": "price ASC NULLS LAST", "price_desc": "price DESC NULLS LAST", "rating": "rating DESC NULLS LAST, score DESC NULLS LAST", "newest": "updated DESC NULLS LAST"}


def facet_sql(depth: int, where: str) -> str:
    return f"WITH {PRODUCTS} SELECT min(path[{depth + 1}]) AS name, count(DISTINCT id) AS products, bool_or(len(path) > {depth + 1}) AS has_children FROM products WHERE {where} AND len(path) > {depth} GROUP BY lower(path[{depth + 1}])"


ORACLE_SQL = {
    "product_filter": f"WITH {RATED} SELECT id, brand, price FROM rated WHERE {MATCH} AND in_stock AND (lower(name) LIKE '%a%' OR lower(name) LIKE '%e%') AND (lower(name) LIKE '%i%' OR lower(name) LIKE '%o%')",
    **{f"sort_{m}": f"WITH {RATED} SELECT brand, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {h}, lower(name), id) AS rank FROM rated WHERE {MATCH}) WHERE rank <= 5" for m, h in HEADS.items()},
    "path_prefix": f"WITH {PRODUCTS} SELECT id, kind FROM products WHERE lower(path[1]) = 'standard' AND lower(path[2]) = 'ring'",
    "category_facets": facet_sql(1, "lower(path[1]) = 'standard'"),
    "root_facets": facet_sql(0, "TRUE"),
    "brand_list": f"WITH {PRODUCTS} SELECT arg_min(brand, id) AS value FROM products WHERE trim(brand) <> '' GROUP BY lower(brand)",
    "discounts": "SELECT l_returnflag, round(avg(CASE WHEN l_extendedprice > 0 AND l_extendedprice * (1 - l_discount) < l_extendedprice THEN 1 - l_extendedprice * (1 - l_discount) / l_extendedprice ELSE 0 END), 6) AS discount, count(*) AS n FROM lineitem GROUP BY 1",
    "cheaper_than": f"WITH {RATED}, shown AS (SELECT brand, min(price) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC NULLS LAST, lower(name), id) AS n FROM rated) WHERE n <= 3 GROUP BY 1) SELECT id, brand, price FROM rated JOIN shown USING (brand) WHERE price < bound",
    "alternatives": f"WITH {PRODUCTS} SELECT * FROM (SELECT c.id AS chosen_id, p.id, p.price, row_number() OVER (PARTITION BY c.id ORDER BY p.price, p.id) AS rank FROM products c JOIN products p ON c.kind = p.kind AND p.price < c.price WHERE c.id % 100 = 0) WHERE rank <= 3",
    "recommend": f"WITH {RATED} SELECT brand, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY md5('17:' || id), id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC NULLS LAST, lower(name), id) AS rank FROM rated) WHERE rank <= 15) WHERE n <= 5",
    "snapshot_carry_forward": "SELECT o_orderkey, o_orderpriority, round(o_totalprice * 2, 2) AS o_totalprice FROM orders",
    "retry_merge": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderstatus = 'P'",
    "run_summary": "SELECT round(success, 6) AS success, round(kept / known, 6) AS retention, success >= 0.6 AND kept / known >= 0.5 AS passes FROM (SELECT avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS success, count(DISTINCT o_custkey) AS kept FROM orders), (SELECT count(*) AS known FROM customer)",
    "composite_dedup": f"WITH {PRODUCTS} SELECT id, brand, size FROM (SELECT *, row_number() OVER (PARTITION BY brand, size, path ORDER BY id) AS n FROM products) WHERE n = 1",
    "type_pivot": "SELECT p_brand AS brand, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 10 AND p_size <= 30) AS middle, count(*) FILTER (p_size > 30) AS large FROM part GROUP BY 1",
}
QUERIES = {name: sorted_by(name[5:]) if name.startswith("sort_") else globals()[name] for name in ORACLE_SQL}

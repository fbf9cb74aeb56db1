"""Queries of property graphs over the foreign keys of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import graph

from .tables import table


def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the whole foreign-key graph by (source label, type, target label)."""
    kinds = [("nation", "n_regionkey", "region", "IN"), ("customer", "c_nationkey", "nation", "FROM"), ("supplier", "s_nationkey", "nation", "FROM"), ("orders", "o_custkey", "customer", "BY"), ("lineitem", "l_partkey", "part", "OF"), ("lineitem", "l_suppkey", "supplier", "VIA")]
    parts = [table(spark, sf_dir, t).where(F.col(c).isNotNull()).agg(F.count("*").alias("edges")).select(F.lit(t).alias("source"), F.lit(k).alias("type"), F.lit(to).alias("target"), "edges") for t, c, to, k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order; of equal dates the one of the smallest key."""
    return graph.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate")], F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = graph.first_reason([("open", F.col("o_orderstatus") == "O"), ("no customer", F.col("c_custkey").isNull()), ("in debt", F.col("c_acctbal") < 0), ("low", F.col("o_priority_low"))])
    joined = joined.withColumn("o_priority_low", F.col("o_orderpriority").startswith("5"))
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("orders"))


def semi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of both a part and a supplier that are retained: small parts, suppliers out of debt."""
    line = table(spark, sf_dir, "lineitem")
    parts, suppliers = table(spark, sf_dir, "part").where("p_size <= 10"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    kept = line.join(parts, line["l_partkey"] == parts["p_partkey"], "left_semi").join(suppliers, F.col("l_suppkey") == suppliers["s_suppkey"], "left_semi")
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("edges"))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that aren't among those out of debt."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return graph.dangling_edges(table(spark, sf_dir, "orders"), rich, "c_custkey", "o_custkey").select("o_orderkey", "o_custkey")


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    return graph.isolated(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", ["o_custkey"]).select("c_custkey", "c_name")


def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers that meet in a nation, counted."""
    s, c, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    left = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    right = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    both = n.join(left, n["n_nationkey"] == left["s_nationkey"]).join(right, n["n_nationkey"] == right["c_nationkey"])
    return both.select("n_name", "suppliers", "customers", (F.col("suppliers") * F.col("customers")).alias("paths"))


def optional_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its orders, if any: an optional pattern."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    spent = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return c.join(spent, c["c_custkey"] == spent["o_custkey"], "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "spent")


def shared_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of more than one order, with their number of orders and suppliers."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers")).where("orders > 1")


def comention_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order divisible by 100, the five orders that share the most parts with it."""
    from corvane.operators.ranking import top_k

    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    seeds = line.where("o % 100 = 0").select(F.col("o").alias("seed"), "p")
    shared = line.join(seeds, "p").where("o != seed").groupBy("seed", "o").agg(F.count_distinct("p").alias("parts"))
    return top_k(shared, ["seed"], [F.desc("parts"), F.asc("o")], 5)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of a customer, and a customer's first order: a sparse graph of orders (2k) and customers (2k + 1)."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("src"), (F.col("o_custkey") * 2 + 1).alias("dst"))
    return o


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = order_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    return graph.components(edges, nodes)


def reachability_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer divisible by 100 reaches in two hops over its orders."""
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") * 2 + 1).alias("seed"))
    return graph.within_hops(order_edges(spark, sf_dir), seeds, 2)


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same text, or in the same source the same words whatever their case and white space, are one entity."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_replace(F.lower("text"), "[ \n]+", " ")
    keyed = docs.select(F.col("doc_id").alias("r"), F.md5("text").alias("url"), F.concat_ws("|", "source", F.md5(words)).alias("sku"))
    return graph.resolved(keyed, "r", ["url", "sku"])


def hole_fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and supplier: first known values by order."""
    line = table(spark, sf_dir, "lineitem")
    flagged = line.withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).withColumn("cut", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return graph.filled(flagged, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], ["flag", "cut", "l_quantity"])


def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt get a new segment; customers 100 after the last are new."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit("REVIEW").alias("c_mktsegment"))
    added = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10_000_000).alias("c_custkey"), F.col("n_name").alias("c_name"), F.lit("NATION").alias("c_mktsegment"))
    return graph.upsert(c, new.unionAll(added), "c_custkey")


def cooccurrence_next2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = graph.cooccurrence(events, "user_id", ["ts", "event_id"], "event_type")
    return found.groupBy("source", "target", "distance").agg(F.count("*").alias("n"))


def bio_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tags: a click begins an entity, a view goes on with it, all else is outside."""
    tag = F.when(F.col("event_type") == "click", "B-act").when(F.col("event_type") == "view", "I-act").otherwise("O")
    events = table(spark, sf_dir, "events").withColumn("tag", tag).withColumn("word", F.col("event_id").cast("string")).withColumn("pos", F.struct("ts", "event_id"))
    return graph.bio_spans(events, "user_id", "pos", "word", "tag").select("user_id", "label", F.col("begin.event_id").alias("begin"), "text")


def timeline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(over).alias("next"))
    return o.where("next is not null")


def endpoint_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of order status and priority against a list of allowed pairs: how many break it."""
    allowed = spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "1-URGENT"), ("O", "3-MEDIUM"), ("P", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    o = table(spark, sf_dir, "orders")
    return o.join(F.broadcast(allowed), ["o_orderstatus", "o_orderpriority"], "left_anti").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("broken"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct ids and null keys of tables that must have unique ids."""
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.count_distinct(k).alias("ids"), F.count_if(F.col(k).isNull()).alias("nulls")).select(F.lit(t).alias("name"), "*") for t, k in (("documents", "doc_id"), ("orders", "o_orderkey"), ("events", "event_id"), ("customer", "c_custkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with its customers and whether it has any."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counted = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return n.join(counted, n["n_nationkey"] == counted["c_nationkey"], "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.col("customers").isNotNull().alias("covered"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in price chapters [begin, end] of 100 each, met by bucket and so by an equality."""
    part = table(spark, sf_dir, "part")
    chapters = part.select((F.floor(F.col("p_retailprice") / 100)).cast("long").alias("bucket")).distinct().withColumn("begin", F.col("bucket") * 100.0).withColumn("finish", F.col("bucket") * 100.0 + 99.5)
    met = part.withColumn("bucket", F.floor(F.col("p_retailprice") / 100).cast("long")).join(chapters, "bucket").where("p_retailprice between begin and finish")
    return met.groupBy("bucket").agg(F.count("*").alias("parts"))


def graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.sources.files import graphml

    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.lit("IN").alias("type"))
    return graphml(nodes, edges)


SQL_EDGES = "e AS (SELECT o_orderkey * 2 AS src, o_custkey * 2 + 1 AS dst FROM orders)"
ORACLE_SQL = {
    "edge_type_counts": " UNION ALL ".join(f"SELECT '{t}' AS source, '{k}' AS type, '{to}' AS target, count({c}) AS edges FROM {t}" for t, c, to, k in [("nation", "n_regionkey", "region", "IN"), ("customer", "c_nationkey", "nation", "FROM"), ("supplier", "s_nationkey", "nation", "FROM"), ("orders", "o_custkey", "customer", "BY"), ("lineitem", "l_partkey", "part", "OF"), ("lineitem", "l_suppkey", "supplier", "VIA")]),
    "latest_version": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "skip_reasons": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN c_custkey IS NULL THEN 'no customer' WHEN c_acctbal < 0 THEN 'in debt' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'kept' END AS reason, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "semi_edges": "SELECT l_suppkey, count(*) AS edges FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "dangling_edges": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)",
    "isolated_nodes": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "two_hop": "SELECT n_name, suppliers, customers, suppliers * customers AS paths FROM nation JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "optional_hop": "SELECT c_custkey, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "shared_entity": "SELECT l_partkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1",
    "comention_expand": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), s AS (SELECT a.o AS seed, b.o, count(DISTINCT p) AS parts FROM l a JOIN l b USING (p) WHERE a.o % 100 = 0 AND a.o <> b.o GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY parts DESC, o) AS rank FROM s) WHERE rank <= 5",
    "components": f"WITH {SQL_EDGES}, n AS (SELECT src AS node, dst FROM e UNION ALL SELECT dst, dst FROM e) SELECT DISTINCT node, least(m, dst) AS component FROM n JOIN (SELECT dst, min(src) AS m FROM e GROUP BY 1) USING (dst)",
    "reachability_n": "WITH s AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 100 = 0) SELECT c * 2 + 1 AS seed, c * 2 + 1 AS node, 0 AS hops FROM s UNION ALL SELECT c * 2 + 1, o_orderkey * 2, 1 FROM s JOIN orders ON o_custkey = c",
    "entity_resolution": """WITH RECURSIVE k AS (SELECT doc_id AS r, md5(text) AS url, concat_ws('|', source, md5(regexp_replace(lower(text), '[ \\n]+', ' ', 'g'))) AS sku FROM documents),
e AS (SELECT DISTINCT r, f FROM (SELECT r, min(r) OVER (PARTITION BY url) AS f FROM k UNION ALL SELECT r, min(r) OVER (PARTITION BY sku) FROM k)), b AS (SELECT r, f FROM e UNION SELECT f, r FROM e),
reach(r, f) AS (SELECT r, f FROM b UNION SELECT reach.r, b.f FROM reach JOIN b ON b.r = reach.f) SELECT r AS node, min(f) AS component FROM reach GROUP BY 1""",
    "hole_fill_merge": "SELECT l_partkey, l_suppkey, arg_min(flag, n) FILTER (flag IS NOT NULL) AS flag, arg_min(cut, n) FILTER (cut IS NOT NULL) AS cut, arg_min(l_quantity, n) AS l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_discount > 0 THEN l_discount END AS cut FROM lineitem) GROUP BY 1, 2",
    "upsert_nodes": "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT n_nationkey + 10000000, n_name, 'NATION' FROM nation",
    "cooccurrence_next2": "WITH l AS (SELECT event_type AS source, lead(event_type, 1) OVER w AS a, lead(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT source, target, distance, count(*) AS n FROM (SELECT source, a AS target, 1 AS distance FROM l UNION ALL SELECT source, b, 2 FROM l) WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2, 3",
    "bio_merge": """WITH t AS (SELECT *, CASE event_type WHEN 'click' THEN 'B-act' WHEN 'view' THEN 'I-act' ELSE 'O' END AS tag FROM events), i AS (SELECT *, sum(CASE WHEN tag <> 'I-act' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM t)
SELECT user_id, 'act' AS label, first(event_id ORDER BY ts, event_id) AS begin, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS text FROM i GROUP BY user_id, g HAVING first(tag ORDER BY ts, event_id) = 'B-act'""",
    "timeline_edges": "SELECT * FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL",
    "endpoint_schema": "SELECT o_orderstatus, o_orderpriority, count(*) AS broken FROM orders WHERE (o_orderstatus, o_orderpriority) NOT IN (VALUES ('F', '1-URGENT'), ('F', '2-HIGH'), ('O', '1-URGENT'), ('O', '3-MEDIUM'), ('P', '5-LOW')) GROUP BY 1, 2",
    "quality_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT {k}) AS ids, count(*) - count({k}) AS nulls FROM {t}" for t, k in (("documents", "doc_id"), ("orders", "o_orderkey"), ("events", "event_id"), ("customer", "c_custkey"))),
    "coverage": "SELECT n_name, count(c_custkey) AS customers, count(c_custkey) > 0 AS covered FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "interval_join": "SELECT floor(p_retailprice / 100)::BIGINT AS bucket, count(*) AS parts FROM part WHERE p_retailprice <= floor(p_retailprice / 100) * 100 + 99.5 GROUP BY 1",
    "graphml_lines": """SELECT 0 AS part, '<node id="' || n_nationkey || '"><data key="label">' || n_name || '</data></node>' AS value FROM nation UNION ALL SELECT 1, '<edge source="' || n_nationkey || '" target="' || n_regionkey || '"><data key="type">IN</data></edge>' FROM nation""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}

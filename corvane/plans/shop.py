"""Queries over the shop's tables: identities in order, bounded claims, paths between orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import commands, graph, identity, nlp, similar, state, vectorindex
from corvane.operators.stored import Tables
from corvane.streaming import live

from . import retrieval
from .tables import table

#: Seconds that a claim holds, and the claims that a scope holds.
TTL, MOST = 6 * 3600, 20
#: Paths of an order, and their longest way.
PATHS, REACH = 12, 4


def first_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients in order of id, each kept unless a kept one before it has its e-mail, name or master."""
    squeezed = F.trim(F.regexp_replace(F.lower("name"), " +", " "))
    kept = identity.first_of_keys(table(spark, sf_dir, "clients"), "client_id", {"email": F.lower("email"), "name": squeezed, "master": F.col("master_id")})
    return kept


def marked(clicks: DataFrame) -> DataFrame:
    """A click claims its client within its kind; one of low value releases it."""
    return clicks.select(F.coalesce("kind", F.lit("none")).alias("kind"), "click_id", "client_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") < 2).alias("release"))


def bounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a time limit, a bound and release."""
    return state.bounded_claims(marked(table(spark, sf_dir, "clicks")), "kind", "client_id", "ts", "release", "click_id", TTL, MOST)


def stream_bounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2 as a stream with map state and timers, started anew for each of three months of clicks on one checkpoint."""
    space = Tables(spark, "claims")
    clicks = marked(table(spark, sf_dir, "clicks"))
    setting, given = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, given)
    try:
        for months in ("ts is null or month(ts) <= 1", "month(ts) = 2", "month(ts) > 2"):
            clicks.where(f"coalesce({months}, false)").write.mode("append").parquet(f"{space.path}/in")
            stream = spark.readStream.schema(clicks.schema).parquet(f"{space.path}/in")
            found = live.bounded_claims(stream, "kind", "client_id", "ts", "release", "click_id", TTL, MOST)
            query = found.writeStream.format("parquet").option("path", f"{space.path}/out").option("checkpointLocation", f"{space.path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema("kind string, click_id long, claimed boolean").parquet(f"{space.path}/out")


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order as a relationship of the order and the part, named by its place."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paths of up to four lines from each order whose key is divisible by 100, none with a line twice."""
    edges = line_edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("ask"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("seed"))
    found = graph.paths(edges, seeds, 0, REACH, PATHS)
    return found.select("ask", "node", F.col("hops").cast("long").alias("hops"), F.array_join("nodes", ">").alias("nodes"), F.array_join(F.col("rels").cast("array<string>"), ">").alias("rels"), F.col("place").cast("long").alias("place"), "truncated")


def supplier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 with a condition on the end, G6: ways from each asked order to another one of the same (smallest) supplier, along two relationships."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    edges = line.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    seeds = line.where("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("ask"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("seed"))
    found = graph.paths(edges, seeds, 1, 2, PATHS, end=F.col("node").startswith("o"))
    return found.select("ask", "node", F.array_join(F.col("rels").cast("array<string>"), ">").alias("rels"), F.col("place").cast("long").alias("place"), "truncated")


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clients' names of a sequence ratio of 0.84 or more, each pair of different spellings once."""
    found = similar.similar(table(spark, sf_dir, "clients").select(F.lower("name").alias("text")), None, 0.84)
    return found.select("a", "b", F.round("ratio", 6).alias("ratio"))


def typo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendors' family names that a word of a client's name nearly is, the vendors in order of their number."""
    vendors = table(spark, sf_dir, "vendors").select(F.lower(F.element_at(F.split("name", " "), -1)).alias("alias"), "vendor_id").groupBy("alias").agg(F.min("vendor_id").alias("place"))
    names = table(spark, sf_dir, "clients").select(F.col("client_id").alias("query_id"), F.col("name").alias("text"))
    found = nlp.typo_matches(names, vendors.select("alias", F.initcap("alias").alias("canonical"), "place"), 0.7)
    return found.select("query_id", "canonical", "word", F.col("start").cast("long").alias("start"), F.round("score", 6).alias("score"))


def index_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 to V3: the ten nearest of every hundredth vector by an inverted file with exact bounds."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    queries = items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    return vectorindex.Index(items, 32).search(queries, 10)


def shop_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of eight forms about each item, read as commands; brands and kinds are those of the items."""
    items = table(spark, sf_dir, "items")
    known = lambda c: items.where(f"{c} is not null").groupBy(F.lower(c).alias("alias")).agg(F.min(c).alias("canonical"), F.min("item_id").alias("place"))
    name, brand, kind = F.coalesce("name", F.lit("thing")), F.coalesce("brand", F.lit("")), F.coalesce("kind", F.lit(""))
    low = F.coalesce(F.floor("price").cast("long"), F.lit(100))
    forms = [("find me %s %s under %s baht in stock", name, brand, low), ("%s %s not %s cheapest please", kind, F.upper(name), brand), ("how to order %s %s", name, brand), ("thanks for the %s", name), ("%s between %s and %s baht sold out", kind, low, 2 * low), ("%s at least %s baht newest", name, low), ("%s", name), ("hello any promotion for %s", brand)]
    message = F.element_at(F.array(*[F.format_string(form, *[a.cast("string") for a in args]) for form, *args in forms]), (F.col("item_id") % 8 + 1).cast("int"))
    found = commands.parsed(items.select(F.col("item_id").alias("id"), message.alias("text")), known("brand"), known("kind"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("brands", "excluded")})


CLAIMS_SQL = f"""WITH RECURSIVE n AS (SELECT coalesce(kind, 'none') AS kind, click_id, client_id::VARCHAR AS id, coalesce(epoch_us(ts) / 1e6, 0.0) AS t, coalesce(value < 2, FALSE) AS gone, row_number() OVER (PARTITION BY coalesce(kind, 'none') ORDER BY coalesce(epoch_us(ts), 0), click_id) AS i FROM clicks),
p AS (SELECT kind, 0::BIGINT AS i, NULL::BIGINT AS click_id, NULL::BOOLEAN AS claimed, []::STRUCT(id VARCHAR, ends DOUBLE)[] AS held FROM (SELECT DISTINCT kind FROM n)
UNION ALL SELECT kind, i, click_id, CASE WHEN gone THEN NULL WHEN coalesce(id, '') = '' THEN TRUE ELSE NOT there END AS claimed,
  CASE WHEN gone THEN list_filter(old, lambda x: x.id IS DISTINCT FROM id) WHEN coalesce(id, '') = '' OR there THEN live ELSE list_append(CASE WHEN len(live) >= {MOST} THEN live[len(live) - {MOST} + 2:] ELSE live END, {{'id': id, 'ends': t + {TTL}}}) END AS held
  FROM (SELECT n.*, p.held AS old, list_filter(p.held, lambda x: x.ends > n.t) AS live, len(list_filter(p.held, lambda x: x.ends > n.t AND x.id = n.id)) > 0 AS there FROM p JOIN n ON n.kind = p.kind AND n.i = p.i + 1))
SELECT kind, click_id, claimed FROM p WHERE i > 0"""

STEPS = "s AS (SELECT id, src AS a, dst AS b FROM e UNION SELECT id, dst, src FROM e)"
ORACLE_SQL = {
    "first_of_keys": """WITH RECURSIVE c AS (SELECT client_id, row_number() OVER (ORDER BY client_id) AS i, list_filter([['e', lower(email)], ['n', trim(regexp_replace(lower(name), ' +', ' ', 'g'))], ['m', master_id::VARCHAR]], lambda x: x[2] IS NOT NULL AND x[2] <> '') AS ks FROM clients),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS client_id, FALSE AS ok, []::VARCHAR[][] AS seen UNION ALL SELECT c.i, c.client_id, NOT list_has_any(seen, ks), CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END FROM f JOIN c ON c.i = f.i + 1)
SELECT client_id FROM f WHERE ok""",
    "bounded_claims": CLAIMS_SQL,
    "stream_bounded_claims": CLAIMS_SQL,
    "order_paths": f"""WITH RECURSIVE e AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem), {STEPS},
w AS (SELECT o_orderkey AS ask, 'o' || o_orderkey AS node, ['o' || o_orderkey] AS nodes, []::BIGINT[] AS rels FROM orders WHERE o_orderkey % 100 = 0
  UNION ALL SELECT ask, s.b, list_append(nodes, s.b), list_append(rels, s.id) FROM w JOIN s ON s.a = w.node WHERE len(rels) < {REACH} AND NOT list_contains(rels, s.id)),
r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY rels, nodes) AS place, count(*) OVER (PARTITION BY ask) > {PATHS} AS truncated FROM w)
SELECT ask, node, len(rels) AS hops, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, place, truncated FROM r WHERE place <= {PATHS}""",
    "supplier_paths": f"""WITH e AS (SELECT l_orderkey AS id, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
r AS (SELECT x.id AS ask, 'o' || y.id AS node, x.id || '>' || y.id AS rels, row_number() OVER (PARTITION BY x.id ORDER BY y.id) AS place, count(*) OVER (PARTITION BY x.id) > {PATHS} AS truncated FROM e x JOIN e y ON y.s = x.s AND y.id <> x.id WHERE x.id % 100 = 0)
SELECT * FROM r WHERE place <= {PATHS}""",
}
ORACLE_SQL["shop_commands"] = """WITH i AS (SELECT item_id AS id, item_id % 8 AS w, coalesce(lower(name), 'thing') AS name, brand, kind, coalesce(floor(price), 100)::BIGINT::DOUBLE AS p FROM items),
e AS (SELECT *, CASE WHEN w IN (1, 4) THEN kind END AS category, CASE WHEN w = 0 THEN coalesce(brand, '') ELSE '' END AS brands, CASE WHEN w = 1 THEN coalesce(brand, '') ELSE '' END AS excluded, CASE WHEN w IN (4, 5) THEN p END AS low, CASE w WHEN 0 THEN p WHEN 4 THEN 2 * p END AS high,
  CASE w WHEN 0 THEN TRUE WHEN 4 THEN FALSE END AS in_stock, CASE w WHEN 1 THEN 'price_asc' WHEN 5 THEN 'newest' END AS sort, CASE WHEN w IN (0, 1, 5) THEN name ELSE '' END AS query, CASE WHEN w IN (0, 1, 4, 5) THEN 'search' ELSE ['', '', 'order', 'thanks', '', '', 'unknown', 'promotion'][w + 1] END AS intent FROM i)
SELECT id, intent, CASE intent WHEN 'search' THEN round(least(0.99, 0.72 + 0.045 * ((category IS NOT NULL)::INT + (brands <> '')::INT + (excluded <> '')::INT + (coalesce(low, high) IS NOT NULL)::INT + (in_stock IS NOT NULL)::INT + (sort IS NOT NULL)::INT + (w = 0)::INT + (query <> '')::INT)), 6) WHEN 'order' THEN 0.97 WHEN 'promotion' THEN 0.97 WHEN 'thanks' THEN 0.96 ELSE 0.2 END AS confidence,
category, brands, excluded, low, high, CASE WHEN low IS NOT NULL THEN TRUE END AS low_inclusive, CASE w WHEN 0 THEN FALSE WHEN 4 THEN TRUE END AS high_inclusive, in_stock, sort, query FROM e"""
ORACLE_SQL["index_l2_topk"] = retrieval.ORACLE_SQL["knn_l2_topk"]
#: Sequence ratios aren't in SQL; tests/test_search.py holds these against all pairs.
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "similar_names", "typo_names"]}

"""Queries of rankings' scores, answers against evidence, lookups by name and records of nested pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import metrics, nlp, ranking, vectorindex
from corvane.sources import html

from . import retrieval
from .tables import table


def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = retrieval.items(spark, sf_dir)
    near = ranking.nearest(retrieval.asked(spark, sf_dir), items, 10)
    return near.join(items.select("item_id", F.col("label").alias("section")), "item_id")


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the ten nearest of every hundredth vector, by class without repeats, against the query's own class."""
    own = retrieval.items(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("label").alias("section"))
    return metrics.section_scores(ranked_labels(spark, sf_dir), own, 5)


def code_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a query's class and the next one, those among its five nearest."""
    own = retrieval.items(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("section"))
    return metrics.recall_of_codes(ranked_labels(spark, sf_dir), own, 5, code="section")


def all_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every vector for every two-hundredth, by inner product to one digit, ties to the larger id."""
    items = retrieval.items(spark, sf_dir)
    asked = items.where("item_id % 200 = 0").withColumnRenamed("item_id", "query_id")
    scored = vectorindex.pairs(asked, items, vectorindex.products).withColumn("score", F.round("score", 1))
    return metrics.full_ranks(scored, "query_id", "item_id", "score").select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the user turn before it."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return turns.where("role = 'assistant'").join(before, ["conv_id", "turn"])


def faithful_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of answers that are in the question, apart from marks of sources."""
    pairs = turn_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.round(metrics.faithfulness(t.tokens(F.col("text")), t.tokens(F.col("asked"))), 6).alias("score"))


def containing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an answer contains the question's first word, by the keys of conversations modulo their first letter."""
    pairs = turn_pairs(spark, sf_dir).withColumn("key", nlp.conversation_key([F.col("role"), F.when(F.col("conv_id") % 4 > 0, F.col("conv_id"))]))
    return metrics.containing_rate(pairs.withColumn("part", F.substring("key", 1, 1)), ["part"], F.col("text"), F.substring_index("asked", " ", 1))


def hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct classes of each query's hits, in order."""
    return ranked_labels(spark, sf_dir).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("section")).cast("array<string>"), ",").alias("pages"))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients asked for by id, by name in other spacing and case, and by e-mail as an alias."""
    clients = table(spark, sf_dir, "clients")
    catalogue = clients.select(F.col("client_id").alias("id"), "name", F.array("email").alias("aliases"))
    way = F.col("client_id") % 4
    asked = clients.select(F.col("client_id").alias("query_id"), F.when(way == 0, F.concat(F.lit(" "), F.col("client_id").cast("string"))).when(way == 1, F.upper(F.concat(F.col("name"), F.lit(" .")))).when(way == 2, F.replace("name", F.lit(" "), F.lit(""))).otherwise(F.upper("email")).alias("text"))
    return nlp.looked_up(asked, catalogue, aliases="aliases")


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on pages of five kinds: page data with sale and regular price and sold out the other way round, linked data in a
    graph, cards within frames and cards, prices as attributes, and numbers that are no price. Where the marked price is none,
    the first number of a card with a sign of money counts."""
    items = table(spark, sf_dir, "items").where("name is not null")
    k, price = F.col("item_id").cast("string"), F.floor("price").cast("long")
    image = F.concat(F.lit("/i/"), k, F.lit(".png"))
    app = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("name").alias("title"), price.alias("price"), F.when(F.col("size") % 2 == 0, price - 1).alias("discount"), (F.col("size") % 3 == 0).alias("soldout"), F.concat(F.lit("/a/"), k).alias("url"), F.struct(image.alias("url")).alias("mainImg"))).alias("products")).alias("page"))).alias("parts")).alias("props")))
    offer = F.struct(price.alias("price"), F.when(F.col("size") % 3 == 0, "https://schema.org/OutOfStock").when(F.col("size") % 3 == 1, "https://schema.org/InStock").alias("availability"))
    linked = F.to_json(F.struct(F.array(F.struct(F.lit("Thing").alias("@type"), F.lit("other").alias("name")).cast("struct<`@type`:string,name:string>")).alias("other"), F.struct(F.array(F.lit("Product")).alias("@type"), F.col("name"), F.array(offer).alias("offers"), F.array(image, F.lit("/x.png")).alias("image"), F.concat(F.lit("/l/"), k).alias("url")).alias("main")))
    shown = F.coalesce(price.cast("string"), F.lit("call"))
    frame = F.concat(F.lit('<ul class="grid"><li class="item"><h2>all</h2><a href="/all">more</a><article class="product-card"><div class="img"><img data-src="'), image, F.lit('"></div><div><h3>'), "name", F.lit('</h3></div><div class="row"><p class="badge">new<div class="price">฿ '), shown, F.lit('</div><del>1,999</del></div><a href="/c/'), k, F.lit('">see</a></article><article class="product-card"><h3>More &amp; '), "name", F.lit('</h3><a href="/d/'), k, F.lit('">see</a><b>sold out</b></article></li></ul>'))
    marked = F.concat(F.lit('<div itemtype="https://schema.org/Product"><img alt="'), "name", F.lit('" src="'), image, F.lit('"><meta itemprop="price" content="'), shown, F.lit('"><a href="/m/'), k, F.lit('">in stock</a></div>'))
    bare = F.concat(F.lit('<section class="card" data-url="/b/'), k, F.lit('"><h4>'), "name", F.lit("</h4> size "), F.col("size").cast("string"), F.lit("</section>"))
    script = lambda kind, body: F.concat(F.lit(f'<html><script type="application/{kind}">'), body, F.lit("</script></html>"))
    page = F.element_at(F.array(script("json", app), script("ld+json", linked), frame, marked, bare), (F.col("item_id") % 5 + 1).cast("int"))
    return html.catalogue(items.select("item_id", page.alias("html")), "item_id", "html").withColumn("n", F.col("n").cast("long"))


KNN = retrieval.ORACLE_SQL["knn_ip_topk"]
RANKED = f"r AS (SELECT k.query_id, k.rank, e.label AS section FROM ({KNN}) k JOIN embeddings e ON e.vec_id = k.item_id)"
PAIRS = "p AS (SELECT a.conv_id, a.turn, a.role, a.text, u.text AS asked FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"
WORDS = "list_distinct(regexp_extract_all(lower({}), '[ก-๙]+|[a-z0-9]+'))"
#: A letter that repeats three times or more stays once.
ONCE = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN regexp_matches({0}[i], '^\\p{{L}}$') AND i > 1 AND {0}[i - 1] = {0}[i] AND ((i > 2 AND {0}[i - 2] = {0}[i]) OR {0}[i + 1] = {0}[i]) THEN '' ELSE {0}[i] END), '')"
NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\p{{L}}ก-๙\\s.฿<>=-]', ' ', 'g'), '\\s+', ' ', 'g'), ' .-')"
ORACLE_SQL = {
    "section_scores": f"""WITH {RANKED}, f AS (SELECT query_id, section, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), section) AS place FROM r GROUP BY 1, 2),
g AS (SELECT t.vec_id AS query_id, count(place) AS sections, min(place) FILTER (f.section = t.label) AS spot FROM embeddings t LEFT JOIN f ON f.query_id = t.vec_id AND place <= 5 WHERE t.vec_id % 100 = 0 GROUP BY 1)
SELECT query_id, CASE WHEN spot IS NULL THEN 0.0 ELSE round(1 / sections, 6) END AS precision, (spot IS NOT NULL)::INT::DOUBLE AS recall, CASE WHEN spot IS NULL THEN 0.0 ELSE round(2 * (1 / sections) / (1 / sections + 1), 6) END AS f1, round(coalesce(1 / spot, 0.0), 6) AS mrr, coalesce(spot = 1, FALSE)::INT::DOUBLE AS hit_at_1, sections FROM g""",
    "code_recall": f"""WITH {RANKED}, x AS (SELECT vec_id AS query_id, unnest(list_distinct([label, (label + 1) % 10])) AS section FROM embeddings WHERE vec_id % 100 = 0)
SELECT x.query_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.query_id = x.query_id AND r.section = x.section AND r.rank <= 5) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM x GROUP BY 1""",
    "all_ranks": "SELECT q.vec_id AS query_id, i.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 1) DESC, i.vec_id DESC) AS rank FROM embeddings q, embeddings i WHERE q.vec_id % 200 = 0",
    "faithful_answers": f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, list_filter({WORDS.format('text')}, lambda x: x[1] <> 's') AS a, {WORDS.format('asked')} AS e FROM p)
SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, e)) / len(a), 6) ELSE 0.0 END AS score FROM w""",
    "containing_answers": f"""WITH {PAIRS}, k AS (SELECT *, CASE WHEN conv_id % 4 > 0 THEN substr(sha256(role || ':' || conv_id), 1, 1) END AS part, split_part(asked, ' ', 1) AS word FROM p)
SELECT part, round(avg(CASE WHEN word <> '' AND contains(lower(text), lower(word)) THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM k GROUP BY 1""",
    "hit_pages": f"WITH {RANKED} SELECT query_id, array_to_string(list_sort(list_distinct(list(section))), ',') AS pages FROM r GROUP BY 1",
    "looked_up": f"""WITH a AS (SELECT client_id AS query_id, CASE client_id % 4 WHEN 0 THEN ' ' || client_id WHEN 1 THEN upper(name || ' .') WHEN 2 THEN replace(name, ' ', '') ELSE upper(email) END AS text FROM clients),
l AS (SELECT client_id AS id, name AS label FROM clients UNION ALL SELECT client_id, email FROM clients), n0 AS (SELECT id, {NORMAL.format('label')} AS k FROM l WHERE label IS NOT NULL), n1 AS (SELECT id, {ONCE.format('k')} AS k, replace({ONCE.format('k')}, ' ', '') AS c FROM n0), n AS (SELECT id, k, {ONCE.format('c')} AS c FROM n1),
q0 AS (SELECT query_id, trim(text) AS raw, {NORMAL.format('text')} AS k FROM a WHERE text IS NOT NULL), q1 AS (SELECT query_id, raw, {ONCE.format('k')} AS k, replace({ONCE.format('k')}, ' ', '') AS c FROM q0), q AS (SELECT query_id, raw, k, {ONCE.format('c')} AS c FROM q1),
f AS (SELECT query_id, client_id AS id, 0 AS step, 'id' AS "by" FROM q JOIN clients ON client_id::VARCHAR = raw UNION ALL SELECT query_id, id, 1, 'name' FROM q JOIN n USING (k) WHERE k <> '' UNION ALL SELECT query_id, id, 2, 'compact' FROM q JOIN n ON n.c = q.c WHERE q.c <> '')
SELECT query_id, id, "by" FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step > 0, id, step) = 1""",
    "nested_records": """WITH i AS (SELECT *, item_id % 5 AS way, floor(price) AS p, '/i/' || item_id || '.png' AS pic FROM items WHERE name IS NOT NULL)
SELECT item_id AS id, 0 AS n, name, CASE way WHEN 0 THEN CASE WHEN size % 2 = 0 AND p <> 1 THEN p - 1 ELSE p END WHEN 2 THEN coalesce(p, 1999.0) WHEN 4 THEN NULL ELSE p END AS price, CASE way WHEN 0 THEN p WHEN 2 THEN 1999.0 END AS regular, ['/a/', '/l/', '/c/', '/m/', '/b/'][way + 1] || item_id AS url, CASE WHEN way <> 4 THEN pic END AS image,
  CASE way WHEN 0 THEN size % 3 <> 0 WHEN 1 THEN CASE size % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END WHEN 3 THEN TRUE END AS in_stock, ['app', 'json-ld', 'card', 'card', 'card'][way + 1] AS kind FROM i
UNION ALL SELECT item_id, 1, 'More & ' || name, NULL, NULL, '/d/' || item_id, NULL, FALSE, 'card' FROM i WHERE way = 2""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}

"""Queries of sources, snapshots, facts and graph jobs. What they read back, they first write in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import facts, graph, jobs, learning, ranking
from corvane.sources import files, html

from .rules import rendered, shared
from corvane.operators.stored import shared_folder

from .tables import table

ORACLE_SQL: dict[str, str] = {}
QUERIES: dict = {}


def registered(sql: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources


@registered("SELECT 'array' AS kind, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'lines', p_partkey, p_name FROM part")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of records (one small file) and a table as JSON lines, written and read back."""
    path = folder(spark, "json")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    array = nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # 25 rows
    array.coalesce(1).write.text(f"{path}/array")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.json(f"{path}/lines")
    a = files.json_records(spark, f"{path}/array", ["n_nationkey", "n_name"], "n_nationkey")
    b = files.jsonl(spark, f"{path}/lines", "p_partkey long, p_name string")
    return a.select(F.lit("array").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionAll(b.select(F.lit("lines"), "p_partkey", "p_name"))


@registered("SELECT c_custkey AS id, c_name AS name, '[\"' || c_mktsegment || '\",\"x\"]' AS tags, CASE WHEN c_custkey % 10 = 0 THEN 'updated' ELSE 'loaded' END AS state FROM customer WHERE c_custkey % 7 <> 0")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with lists to CSV with a byte-order mark and back, blank keys left out, upserted."""
    path = folder(spark, "csv")
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")).otherwise(" ")
    files.write_csv(c.select(key.alias("﻿id"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.lit("x")).alias("tags")), path)
    read = files.csv_table(spark, path, ["id", "name", "tags"], "id").withColumn("id", F.col("id").cast("long")).withColumn("state", F.lit("loaded"))
    new = read.where("id % 10 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tags"), F.lit("updated").alias("state"))
    return graph.upsert(read, new, "id")


@registered("SELECT n_nationkey::BIGINT AS id, n_name AS name, 'nation' AS type, 64 AS digest FROM nation")
def source_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a bundle file (25 of them), and the length of the file's digest."""
    path = folder(spark, "bundle")
    nation = table(spark, sf_dir, "nation")
    objects = nation.agg(F.to_json(F.struct(F.lit("bundle").alias("type"), F.collect_list(F.struct(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("objects"))).alias("value"))
    objects.coalesce(1).write.text(path)
    digests = files.digest(spark, f"{path}/*.txt").select(F.length("sha256").alias("digest")).distinct()
    return files.bundle(spark, path, "kind string, id long, name string").select("id", "name", F.col("kind").alias("type")).crossJoin(F.broadcast(digests))  # one file


@registered("SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS page, n_name || ' page' AS text, length(n_name) + 5 AS long FROM nation")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pages apart by form feeds, one of each region."""
    path = folder(spark, "pages")
    nation = table(spark, sf_dir, "nation")
    whole = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_name"], F.lit(" page"))), "\f").alias("value"))
    whole.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    read = files.text_pages(spark, f"{path}/*/*.txt")
    region = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int")
    return read.select(region.alias("region"), "page", F.rtrim("text", F.lit("\n")).alias("text")).withColumn("long", F.length("text").cast("long"))


@registered("SELECT 2 AS version, (SELECT count(*) FROM part) AS rows, round((SELECT sum(p_retailprice) FROM part), 2) AS total, FALSE AS rebuild_same, TRUE AS rebuild_other, 1 AS older")
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with manifests; an unfinished one is passed over; fingerprints decide a rebuild."""
    path = folder(spark, "snapshot")
    part = table(spark, sf_dir, "part")
    files.write_snapshot(part.where("p_size < 10"), path, 1, {"fingerprint": "a", "dimensions": 3})
    files.write_snapshot(part, path, 2, {"fingerprint": "b", "dimensions": 4})
    part.limit(1).write.parquet(f"{path}/v=3/rows")  # a writer that died before its manifest
    rows, manifest = files.read_snapshot(spark, path)
    _, older = files.read_snapshot(spark, path, dimensions=3)
    one = rows.agg(F.count("*").alias("rows"), F.round(F.sum("p_retailprice"), 2).alias("total"))
    return one.select(F.lit(manifest["version"]).alias("version"), "rows", "total", F.lit(files.needs_rebuild(spark, path, "b")).alias("rebuild_same"), F.lit(files.needs_rebuild(spark, path, "c")).alias("rebuild_other"), F.lit(older["version"]).alias("older"))


@registered("SELECT 'https://x.example/' || n_regionkey || '/' || n_name AS loc FROM nation")
def source_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of sitemaps, one of each region."""
    nation = table(spark, sf_dir, "nation")
    entry = F.concat(F.lit("<url><loc>https://x.example/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"), F.lit("</loc></url>"))
    xml = nation.groupBy("n_regionkey").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("value"))
    return html.sitemap(xml)


PAGES = """SELECT p_partkey AS id, p_name AS name, CAST(p_size AS DOUBLE) AS price, CAST(p_size % 3 AS INT) AS kind, p_size % 2 = 0 AS stock FROM {part}"""


@registered(f"""SELECT id, 0 AS n, name, price, CASE WHEN kind = 2 THEN '/p/' || id ELSE 'https://x.example/p/' || id END AS url, CASE WHEN kind < 2 THEN stock END AS in_stock, CASE kind WHEN 0 THEN 'app' WHEN 1 THEN 'json-ld' ELSE 'card' END AS kind FROM ({shared(PAGES)}) WHERE id % 5 <> 0""")
def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products rendered as page data, linked data and cards, then read back; some pages say they are empty."""
    rows = rendered(spark, sf_dir, PAGES)
    own = F.concat(F.lit("https://x.example/p/"), F.col("id").cast("string"))
    app = F.concat(F.lit('<script type="application/json">'), F.to_json(F.struct(F.struct(F.array(F.struct("name", "price", own.alias("url"), F.col("stock").alias("in_stock"))).alias("products")).alias("props"))), F.lit("</script>"))
    offer = F.struct("price", F.when(F.col("stock"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"))
    linked = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Product").alias("@type"), "name", own.alias("url"), offer.alias("offers"))), F.lit("</script>"))
    card = F.concat(F.lit('<div class="product"><h2>'), "name", F.lit('</h2><a href="/p/'), F.col("id").cast("string"), F.lit('">see</a><span class="price">'), F.col("price").cast("string"), F.lit("</span></div>"))
    nothing = f'<script id="{html.LIST_SCRIPT}" type="application/json">{{"props": {{"pageProps": {{"pageProps": {{"productPageProps": {{"products": []}}}}}}}}}}</script><p>No products <b>found</b></p>'
    page = F.when(F.col("id") % 5 == 0, nothing).when(F.col("kind") == 0, app).when(F.col("kind") == 1, linked).otherwise(card)
    pages = rows.select("id", page.alias("html"))
    kept = pages.where(~html.explicitly_empty(F.col("html")))
    return html.catalogue(kept, "id", "html").select("id", "n", "name", "price", "url", "in_stock", "kind")


# -- facts

FACTS = "SELECT p_partkey AS fact_id, CASE WHEN p_size % 11 = 0 THEN 'ghost' ELSE split_part(p_name, ' ', 2) END AS subject, CASE WHEN p_size % 7 = 0 THEN 'place' ELSE 'thing' END AS subject_type, CASE WHEN p_size % 13 = 0 THEN 'likes' ELSE 'is' END AS relation, split_part(p_name, ' ', 1) AS object, 'quality' AS object_type, concat('The ', split_part(p_name, ' ', 1), '  ', split_part(p_name, ' ', 2)) AS evidence, p_partkey AS page, concat('Intro. The ', p_name, ' is here') AS text FROM {part}"


@registered(f"""WITH f AS ({shared(FACTS)}), b AS (SELECT *, CASE WHEN relation <> 'is' THEN 'unknown relation' WHEN subject_type <> 'thing' THEN 'wrong types' WHEN subject = 'ghost' THEN 'ungrounded' ELSE 'accepted' END AS bad FROM f)
SELECT fact_id, CASE WHEN bad = 'accepted' AND row_number() OVER (PARTITION BY lower(subject), relation, lower(object), bad ORDER BY fact_id) > 1 THEN 'duplicate' ELSE bad END AS reason FROM b""")
def fact_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, grounded and single facts, each with the first reason against it."""
    rows = rendered(spark, sf_dir, FACTS)
    schema = spark.createDataFrame([("thing", "is", "quality")], "subject_type string, relation string, object_type string")
    return facts.accepted(rows.drop("text"), rows.select("page", "text"), schema, ["is"]).select("fact_id", "reason")


@registered("SELECT p_partkey AS id, p_name AS name, 'extracted' AS origin FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 4 <> 0 UNION ALL SELECT p_partkey + 1000000000, p_name, 'review' FROM part WHERE p_partkey % 9 = 0")
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources replaced whole (twice, with one result), then reviewed rows out and in, each with its origin."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 4).alias("source"))
    empty = part.where("source = 0").limit(0)
    gone = part.where("source = 0").select("source").distinct()
    new = part.where("source = 1")
    once = facts.replaced_source(part.join(gone, "source", "left_anti"), new, "source")
    twice = facts.replaced_source(once.unionByName(empty), new, "source").select("id", "name")
    added = part.where("id % 9 = 0").select((F.col("id") + 1000000000).alias("id"), "name")
    return facts.reviewed(twice, part.where("id % 9 = 0").select("id"), added, "id")


EVIDENCE = "SELECT p_partkey AS id, CAST(p_partkey / 100 AS BIGINT) AS page, CAST(p_partkey % 100 + CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 5 END AS BIGINT) AS at, concat('part ', CAST(p_partkey AS STRING), ' x') AS evidence FROM {part}"
EVIDENCE = EVIDENCE.replace("CAST(p_partkey / 100 AS BIGINT)", "CAST(floor(p_partkey / 100.0) AS BIGINT)")


@registered("SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN (p_partkey % 100)::BIGINT END AS found_at FROM part")
def neighbour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence on its line, or on the one line near it that holds it."""
    rows = rendered(spark, sf_dir, EVIDENCE.replace(" AS at,", " AS pos,"))
    lines = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100.0).alias("page"), (F.col("p_partkey") % 100).alias("line_no"), F.concat(F.lit("this is Part"), F.col("p_partkey").cast("string"), F.lit("  X of it")).alias("line"))
    return facts.neighbour_repair(rows, lines, "id", "page", "pos", "evidence").select("id", "found_at")


@registered("""WITH r AS (SELECT DISTINCT p_brand AS brand, split_part(p_name, ' ', 2) AS name FROM part), c AS (SELECT p_brand AS brand, CASE split_part(p_name, ' ', 2) WHEN 'gizmo' THEN 'gear' ELSE split_part(p_name, ' ', 2) END AS name, count(*) AS n FROM part WHERE p_size % 4 = 0 GROUP BY 1, 2)
SELECT r.brand, r.name, coalesce(n, 0) AS candidates, n IS NOT NULL AS found FROM r LEFT JOIN c ON c.brand = r.brand AND c.name = CASE r.name WHEN 'gizmo' THEN 'gear' ELSE r.name END""")
def reviewed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed names against candidates of the same brand, by canonical names."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name"), "p_size")
    want = part.select("brand", F.lower("name").alias("name")).distinct()
    return facts.bipartite_matches(part.where("p_size % 4 = 0"), want, ["brand"], {"gizmo": "gear"}, "name")


@registered("""WITH e(node, parent) AS (VALUES ('ring', 'metal'), ('rod', 'metal'), ('metal', 'thing'), ('gear', 'machine'), ('gizmo', 'machine'), ('machine', 'thing'), ('bolt', 'metal')),
u(node, ancestor, steps) AS (SELECT node, node, 0 FROM (SELECT node FROM e UNION SELECT parent FROM e) UNION ALL SELECT node, parent, 1 FROM e UNION ALL SELECT a.node, b.parent, 2 FROM e a JOIN e b ON b.node = a.parent),
p AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS a, p.w AS b FROM part, (VALUES ('ring'), ('gear')) p(w)),
m AS (SELECT a, b, min((x.steps + y.steps, x.ancestor)) AS best FROM p JOIN u x ON x.node = a JOIN u y ON y.node = b AND y.ancestor = x.ancestor GROUP BY 1, 2)
SELECT a, b, coalesce(round(1 / (1 + best[1]), 6), 0.0) AS similarity, best[2] AS meets FROM p LEFT JOIN m USING (a, b)""")
def concept_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity over the nearest common ancestor."""
    tree = spark.createDataFrame([("ring", "metal"), ("rod", "metal"), ("metal", "thing"), ("gear", "machine"), ("gizmo", "machine"), ("machine", "thing"), ("bolt", "metal")], "node string, parent string")
    names = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("a")).distinct()
    pairs = names.crossJoin(F.broadcast(spark.createDataFrame([("ring",), ("gear",)], "b string")))  # two rows
    return facts.path_similarity(tree, pairs, 2)


@registered("""WITH r AS (SELECT p_brand AS brand, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
s AS (SELECT *, len(list_intersect(string_split(name, ' '), ['red', 'ring', 'gear'])) / len(list_distinct(list_concat(string_split(name, ' '), ['red', 'ring', 'gear']))) AS score FROM r WHERE rank <= 8)
SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN id % 7 <> 0 THEN score END DESC NULLS LAST, rank) AS position FROM s QUALIFY position <= 3""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight of each brand by word overlap with a query, rows without a finite score last."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_retailprice")
    ranked = ranking.top_k(part, ["brand"], [F.desc("p_retailprice"), F.asc("id")], 8).withColumn("q", F.lit("red ring gear"))
    score = lambda q, x: F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(t.jaccard(t.tokens(x), t.tokens(q)))
    return facts.reranked(ranked, score, ["brand"], "q", "name", "rank", 8, 3).select("brand", "id", "position")


# -- graph jobs

STORE = "SELECT c_custkey AS id, 'a' AS dataset, c_name AS name, c_nationkey AS nation FROM {customer}"


@registered("SELECT count(*) FILTER (c_custkey % 5 = 0) AS added, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 50 <> 1) AS same, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 50 = 1) AS conflicts, 1 AS foreign, FALSE AS allowed FROM customer")
def snapshot_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a claim adds, what it would change, and whether another dataset is there."""
    new = rendered(spark, sf_dir, STORE)
    name = F.when(F.col("id") % 50 == 1, F.lit("other")).otherwise(F.col("name"))
    stored = new.where("id % 5 != 0").withColumn("name", name).withColumn("dataset", F.when(F.col("id") % 100 == 2, "b").otherwise("a"))
    return jobs.claims(stored, new, "id", "dataset")


@registered("SELECT id, relation, object FROM (SELECT p_partkey AS id, 'type' AS relation, p_type AS object FROM part UNION ALL SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size % 3 <> 0)")
def fact_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with lists and gaps as single facts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", F.split("p_name", " ").alias("words"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"))
    return jobs.expanded_facts(rows, "id", {"p_type": "type", "words": "word", "size": "size"})


@registered("""WITH e AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS i, l_returnflag AS ev FROM lineitem WHERE l_suppkey % 3 = 0 AND l_quantity > 40), n AS (SELECT 'case:' || c AS id, 'case' AS kind, ev FROM e UNION ALL SELECT 'item:' || i, 'item', ev FROM e)
SELECT id, kind, array_to_string(list_sort(list(DISTINCT ev)), ',') AS evidence, (SELECT count(*) FROM (SELECT DISTINCT c, i FROM e)) AS edges FROM n GROUP BY 1, 2""")
def reviewed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of reviewed cases and the known items they name."""
    cases = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("evidence"))
    items = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    nodes, edges = jobs.reviewed_graph(cases, items, "l_orderkey", "l_suppkey", "evidence")
    return nodes.withColumn("evidence", F.array_join("evidence", ",")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row


PATHS = "SELECT n_nationkey AS src, CAST((n_nationkey * 2 + 1) % 25 AS INT) AS dst FROM {nation}"


def hops_sql(most: int, where: str = "TRUE") -> str:
    return f"""e AS (SELECT src, dst FROM ({shared(PATHS)}) WHERE {where}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(seed, node, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey IN (0, 3) UNION SELECT seed, dst, hops + 1 FROM w JOIN b ON b.src = node WHERE hops < {most}), r AS (SELECT seed, node, min(hops) AS hops FROM w GROUP BY 1, 2)"""


@registered(f"WITH RECURSIVE {hops_sql(6)} SELECT seed, node, hops FROM r")
def six_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to six edges in any direction."""
    seeds = table(spark, sf_dir, "nation").where("n_nationkey in (0, 3)").select(F.col("n_nationkey").alias("seed"))
    return graph.within_hops(rendered(spark, sf_dir, PATHS), seeds, 6)


@registered(f"WITH RECURSIVE {hops_sql(3, 'src % 4 <> 2 AND dst % 4 <> 2')} SELECT n_nationkey AS id, n_name AS name, (SELECT min(hops) FROM r WHERE node = n_nationkey) AS hops FROM nation WHERE n_nationkey % 4 <> 2")
def promoted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved nodes and whether seeds reach them over approved edges."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    seeds = nodes.where("id in (0, 3)").select(F.col("id").alias("seed"))
    return jobs.promoted(nodes, rendered(spark, sf_dir, PATHS), F.col("id") % 4 != 2, seeds, 3)


@registered("""WITH c AS (SELECT p_partkey AS chunk, 'see the ' || upper(p_name) || ', ' || p_type AS text FROM part), e AS (SELECT DISTINCT p_name AS entity FROM part WHERE p_size % 2 = 0 UNION SELECT 'small')
SELECT chunk, entity FROM c, e WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || entity || ' ')""")
def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that each chunk names."""
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.col("p_partkey").alias("chunk"), F.concat(F.lit("see the "), F.upper("p_name"), F.lit(", "), "p_type").alias("text"))
    names = part.where("p_size % 2 = 0").select(F.col("p_name").alias("name")).union(spark.createDataFrame([("small",)], "name string"))
    return jobs.chunk_links(chunks, names, "chunk", "name")


@registered("SELECT l_suppkey AS page, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, min(l_linenumber) AS first FROM lineitem GROUP BY 1")
def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with lists of pages, unwound to one view of each page."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.array("l_suppkey").alias("pages"))
    return line.select("l_partkey", "l_orderkey", "l_linenumber", F.explode("pages").alias("page")).groupBy("page").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.min("l_linenumber").alias("first"))


@registered("SELECT 'MERGE (n:Part {id: ''' || p_partkey || '''}) SET n.name = ''' || replace(p_name, ' ', chr(92) || ''' ') || ''', n.kind = ' || CASE WHEN p_size % 2 = 0 THEN '''' || p_type || '''' ELSE 'null' END || ';' AS statement FROM part")
def graph_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals and keyed merges of a script."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("' ")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"))
    return jobs.script(nodes, "Part", "id", ["name", "kind"])


@registered("SELECT id, n::INT AS n, question, answer FROM (SELECT p_partkey AS id, 0 AS n, 'What is ' || p_name || '?' AS question, 'A ' || p_type AS answer FROM part UNION ALL SELECT p_partkey, 1, 'Who makes it?', p_brand || chr(10) || 'Ask them.' FROM part)")
def markdown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of Markdown sections."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("# Title\n\n## What is "), "p_name", F.lit("?\nA "), "p_type", F.lit("\n\n## Who makes it?\n\n"), "p_brand", F.lit("\nAsk them.\n")).alias("text"))
    return jobs.question_sections(texts, "text")


@registered("SELECT region, province, name, address FROM (SELECT n_regionkey AS region, n_regionkey || 'th' AS province, n_name AS name, 'Road ' || n_nationkey AS address FROM nation)")
def branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches under their province, the first of each name."""
    nation = table(spark, sf_dir, "nation")
    head = nation.select("n_regionkey").distinct().select(F.col("n_regionkey").alias("region"), F.lit(-1).alias("at"), F.concat(F.lit("#  province of "), F.col("n_regionkey").cast("string"), F.lit("th ")).alias("line"))
    line = F.concat(F.lit("- "), F.col("n_name"), F.lit(": Road "), F.col("n_nationkey").cast("string"))
    rows = nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("at"), line.alias("line"))
    again = nation.select("n_regionkey", F.col("n_nationkey") + 100, F.concat(F.lit("- "), F.lower("n_name"), F.lit(" : elsewhere")))
    return jobs.branches(head.unionAll(rows).unionAll(again), "line", "at", "region")


@registered("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'M' || p_partkey END AS ref, list_sort(list_distinct(list_concat(string_split(p_name, ' '), CASE WHEN p_size % 2 = 0 THEN [split_part(p_name, ' ', 2), p_type] ELSE [] END))) AS aliases, starts_with(p_type, 'S') AS prefixed, len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) > 0 AS any_of, array_to_string(string_split(p_name, ' '), ' > ') AS path FROM part")
def entity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference of a source, aliases of two lists, prefixes, any-of, paths as text."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    refs = F.array(F.struct(F.lit("web").alias("source"), F.lit("W").alias("id")), F.struct(F.when(F.col("p_size") % 3 == 0, "main").otherwise("other").alias("source"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("id")))
    rows = p.select(F.col("p_partkey").alias("id"), refs.alias("refs"), words.alias("one"), F.when(F.col("p_size") % 2 == 0, F.array(words[1], F.col("p_type"))).alias("two"), "p_type")
    out = jobs.projected(rows, "id", "refs", "main", ["one", "two"])
    more = rows.select("id", t.has_prefix(F.split("p_type", ""), F.array(F.lit("S"))).alias("prefixed"), F.arrays_overlap("one", F.array(F.lit("red"), F.lit("ring"))).alias("any_of"), F.array_join("one", " > ").alias("path"))
    return out.join(more, "id")


@registered("SELECT * FROM (SELECT o_orderkey AS id, o_orderdate AS published, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1998-01-01') WHERE place <= 5")
def current_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on at a date, newest first, five at most (a report)."""
    from pyspark.sql import Window

    on = F.lit("1998-01-01").cast("timestamp")
    live = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= on) & (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS") >= on)).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published"))
    return live.orderBy(F.desc("published"), F.desc("id")).limit(5).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("published"), F.desc("id"))).cast("long"))


@registered("SELECT 'lines' AS kind, count(*) AS n, 10 AS dimensions FROM part")
def encoder_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets a finite vector of the asked size."""
    from corvane.functions import vectors

    encode = learning.encoder(learning.hashing_encoder(10))
    rows = table(spark, sf_dir, "part").select(encode(F.col("p_name")).alias("vector"))
    return rows.where(vectors.valid(F.col("vector"), 10)).agg(F.lit("lines").alias("kind"), F.count("*").alias("n"), F.lit(10).alias("dimensions"))



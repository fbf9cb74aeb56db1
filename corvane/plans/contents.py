"""Queries over JSON trees: leaves of any depth, and records of a content store whose entries point at each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import graph, nlp, ranking
from corvane.operators.stored import Tables
from corvane.sources import cms
from corvane.sources.feeds import Conflict, Feeds

from . import retrieval
from .tables import table

#: Items known by another name: name and aliases.
KNOWN = {"large widget": ("Big Widget", ["widget xl", "the big one"]), "small plate": ("Saucer", []), "small bolt": ("Pin", ["pin", "Pin"])}
MENU, OFFERS, SITE = "https://shop.example/menu", "https://shop.example/offers", "https://shop.example/"


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all scalars in the clicks' JSON, positions left out, with how many there are and how many clicks have one."""
    found = cms.leaves(table(spark, sf_dir, "clicks"), "click_id", "props")
    path = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return found.groupBy(path.alias("path"), "kind").agg(F.count("*").alias("n"), F.count_distinct("click_id").alias("clicks"), F.count_distinct("value").alias("different"))


def content_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as an entry of one of three types, in JSON; it points at the two items after it, the first one twice, and at two pictures."""
    items = table(spark, sf_dir, "items").withColumn("name", F.coalesce("name", F.lit("thing")))
    k, size, price = F.col("item_id"), F.coalesce("size", F.lit(0)), F.floor("price").cast("long")
    link = lambda c: F.struct(F.struct(F.lit("Link").alias("type"), c.cast("string").alias("id")).alias("sys"))
    node = lambda value: F.struct(F.lit("text").alias("nodeType"), value.alias("value"))
    shown = F.coalesce(F.concat(F.format_number(price, 0), F.lit(" บาท")), F.lit("ask us"))
    block = lambda *nodes: F.struct(F.lit("paragraph").alias("nodeType"), F.array(*nodes).alias("content"))
    body = F.struct(F.lit("document").alias("nodeType"), F.array(block(node(F.concat(F.lit("  "), "name"))), block(node(F.concat(F.lit("size "), size.cast("string"))), node(shown), node(F.lit(" ")), node(F.coalesce("kind", F.lit("any"))))).alias("content"))
    both = [F.array(link(k + 1), link(k + 2), link(k + 1)).alias("components"), F.array(link(F.concat(F.lit("none"), k.cast("string"))), link(k % 7), link(k % 11)).alias("image")]
    page = F.struct(F.concat_ws(" ", "brand", "name").alias("name"), body.alias("body"), *both)
    item = F.struct(F.concat(F.col("name"), F.lit(" ("), F.coalesce("brand", F.lit("-")), F.lit(")")).alias("itemName"), F.when(size % 2 == 0, F.concat(F.lit("long  "), "kind")).alias("longDescription"), F.col("kind").alias("shortDescription"), *both)
    day = lambda n: F.concat(F.date_add(F.lit("2024-01-01").cast("date"), n).cast("string"), F.lit("T00:00:00Z"))
    offer = F.struct(
        F.when(size % 4 > 0, F.col("name")).alias("headline"), F.coalesce("brand", F.lit("-")).alias("displayTitle"), F.col("kind").alias("subHeadline"), F.concat(F.lit("now ฿"), price.cast("string")).alias("description"),
        day(size.cast("int")).alias("startDate"), F.when(size % 2 == 0, day(size.cast("int") + 40)).alias("endDate"), F.when(size % 5 == 0, F.array(F.lit("Mon"), F.lit("Tue"))).alias("applicableDays"),
        F.when(size % 3 == 1, F.concat(F.lit("/deals/"), k.cast("string"))).when(size % 3 == 2, F.lit("https://other.example/d")).alias("onClick"), *both,
    )
    field = lambda s: F.to_json(F.struct(s.alias("fields")))
    way = k % 3
    return items.select(k.alias("entry_id"), F.when(way == 0, "page").when(way == 1, "item").otherwise("promotion").alias("type"), F.when(way == 0, field(page)).when(way == 1, field(item)).otherwise(field(offer)).alias("body"))


def content_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu items, items known by another name, and the promotions of a day, with the entries and pictures they point at."""
    pictures = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("asset_id"), F.concat(F.when(F.col("vendor_id") % 3 == 0, "ftp").otherwise("https"), F.lit("://img.example/"), F.col("vendor_id").cast("string"), F.lit(".png?w=9#top")).alias("url"))
    now = F.lit("2024-02-10T12:00:00Z").cast("timestamp")
    found = cms.records(content_entries(spark, sf_dir), pictures, KNOWN, now, MENU, OFFERS, SITE)
    return found.select("entry_id", "id", "kind", "name", "price", "description", F.array_join("aliases", "|").alias("aliases"), F.array_join("components", "|").alias("components"), "image_url", "url")


ORACLE_SQL = {
    "tree_leaves": """WITH j AS (SELECT c.click_id, regexp_replace(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g') AS path, t.type AS kind, coalesce(json_extract_string(t.atom, '$'), '') AS value, t.atom FROM clicks c, json_tree(CASE WHEN json_valid(c.props) THEN c.props END) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))
SELECT path, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN 'bigint' WHEN kind = 'VARCHAR' THEN 'string' WHEN kind = 'DOUBLE' THEN 'decimal' ELSE lower(kind) END AS kind, count(*) AS n, count(DISTINCT click_id) AS clicks, count(DISTINCT CASE WHEN kind <> 'NULL' THEN value END) AS different FROM j GROUP BY 1, 2""",
    "content_records": f"""WITH i AS (SELECT item_id AS k, coalesce(name, 'thing') AS name, brand, kind, coalesce(size, 0) AS size, floor(price)::BIGINT AS p FROM items),
t AS (SELECT k, CASE k % 3 WHEN 0 THEN concat_ws(' ', brand, name) WHEN 1 THEN name || ' (' || coalesce(brand, '-') || ')' ELSE CASE WHEN size % 4 > 0 THEN name ELSE coalesce(brand, '-') END END AS title FROM i),
c AS (SELECT i.k, string_agg(title, '|' ORDER BY pos) AS components, '[' || string_agg('"' || title || '"', ',' ORDER BY pos) || ']' AS listed FROM i, LATERAL (SELECT title, min(t.k) AS pos FROM t WHERE t.k IN (i.k + 1, i.k + 2) GROUP BY 1) GROUP BY 1),
v AS (SELECT vendor_id, 'https://img.example/' || vendor_id || '.png' AS url FROM vendors WHERE vendor_id % 3 > 0),
r AS (SELECT k, 'menu' AS kind, name, '฿' || format('{{:,}}', p) || '.00' AS price, 'size ' || size || chr(10) || coalesce(kind, 'any') AS description, concat_ws('|', nullif(concat_ws(' ', brand, name), name), name) AS aliases, '{MENU}' AS url FROM i WHERE k % 3 = 0 AND p IS NOT NULL
UNION ALL SELECT k, 'menu', CASE name WHEN 'large widget' THEN 'Big Widget' WHEN 'small plate' THEN 'Saucer' ELSE 'Pin' END, '', CASE WHEN size % 2 = 0 THEN 'long ' ELSE '' END || kind, name || ' (' || coalesce(brand, '-') || ')' || CASE name WHEN 'large widget' THEN '|widget xl|the big one' WHEN 'small bolt' THEN '|pin|Pin' ELSE '' END, '{MENU}' FROM i WHERE k % 3 = 1 AND kind IS NOT NULL AND name IN ('large widget', 'small plate', 'small bolt')
UNION ALL SELECT k, 'promotion', CASE WHEN size % 4 > 0 THEN name ELSE coalesce(brand, '-') END, coalesce('฿' || format('{{:,}}', p) || '.00', ''),
  concat_ws(chr(10), kind, 'now ฿' || p, CASE WHEN size % 5 = 0 THEN 'ใช้ได้: Mon, Tue' END, 'ช่วงโปรโมชัน: ' || (DATE '2024-01-01' + size::INT) || 'T00:00:00Z ถึง ' || CASE WHEN size % 2 = 0 THEN (DATE '2024-01-01' + size::INT + 40) || 'T00:00:00Z' ELSE '-' END),
  concat_ws('|', CASE WHEN size % 4 > 0 THEN name ELSE coalesce(brand, '-') END, kind), CASE size % 3 WHEN 1 THEN '{SITE}deals/' || k WHEN 2 THEN 'https://other.example/d' ELSE '{OFFERS}' END FROM i WHERE k % 3 = 2 AND size <= 40 AND (size % 2 = 1 OR size >= 1))
SELECT r.k::VARCHAR AS entry_id, substr(sha1(concat_ws(chr(31), r.kind, name, description, r.url, coalesce(listed, '[]'))), 1, 16) AS id, r.kind, name, price, description, aliases, coalesce(components, '') AS components, coalesce(a.url, b.url, '') AS image_url, r.url
FROM r LEFT JOIN c USING (k) LEFT JOIN v a ON a.vendor_id = r.k % 7 LEFT JOIN v b ON b.vendor_id = r.k % 11""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}


def replaced_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clients' sources as feeds; web is replaced by its rows in credit, a writer that comes late changes nothing, and store goes."""
    clients = table(spark, sf_dir, "clients").select("client_id", "source", "balance")
    store = Feeds(spark, Tables(spark, "feeds").path)
    own = F.coalesce(F.when(F.col("source").isin("crm", "web", "store"), F.col("source")), F.lit("other"))
    for name in ("crm", "web", "store", "other"):
        store.replace(name, clients.where(own == name))
    seen = store.version()
    store.replace("web", clients.where((own == "web") & (F.col("balance") > 0)), seen)
    try:
        store.replace("web", clients.where(own == "crm"), seen)
    except Conflict:
        store.replace("store", None, seen)
    return store.read().groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


ORACLE_SQL["replaced_feeds"] = "SELECT source, count(*) AS n, round(sum(balance), 2) AS total FROM clients WHERE source IS DISTINCT FROM 'store' AND (source IS DISTINCT FROM 'web' OR balance > 0) GROUP BY 1"
QUERIES["replaced_feeds"] = replaced_feeds


def question_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a question names, else those of its vector search. An entity is a vector, named by its document's first two words."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.lower(F.array_join(F.slice(F.split("text", " "), 1, 2), " ")).alias("name"), "text")
    items = retrieval.items(spark, sf_dir)
    catalogue = items.select(F.col("item_id").alias("id")).join(docs, "id").select("id", F.array("name", F.concat(F.lit("T"), F.format_string("%04d", "id"))).alias("terms"))
    asked = retrieval.asked(spark, sf_dir)
    way = F.col("query_id") % 300
    told = F.when(way == 0, F.upper("text")).when(way == 100, F.concat(F.lit("What is (T"), F.format_string("%04d", F.col("query_id") + 1), F.lit("), not T"), F.format_string("%04d", F.col("query_id") + 2), F.lit(".001?"))).otherwise("what is there")
    questions = asked.join(docs.withColumnRenamed("id", "query_id"), "query_id").select("query_id", told.alias("text"))
    hits = ranking.nearest(asked, items, 10).select("query_id", F.col("item_id").alias("id"))
    return nlp.seeds(questions, catalogue, hits)


def crossing_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients whose master record is of another source."""
    clients = table(spark, sf_dir, "clients")
    return graph.crossing(clients.select("client_id", "master_id"), clients, "client_id", "source", "client_id", "master_id")


def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clients whose name or e-mail holds the beginning of a vendor's family name."""
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), F.array("name", "email").alias("labels"))
    asked = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("query_id"), F.concat(F.lit(" "), F.substring(F.element_at(F.split("name", " "), -1), 1, 5), F.lit(".")).alias("text"))
    return nlp.label_matches(asked, clients)


def kept_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with joiners and tabs after commas, normalised without losing the parting of words."""
    marked = F.concat(F.lit("\ufeff"), F.replace("text", F.lit(", "), F.lit(",\u200d\t ")), F.lit(" \n \n\n end\u00a0"))
    made = table(spark, sf_dir, "documents").select("doc_id", t.broken(marked).alias("text"))
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


ORACLE_SQL |= {
    "question_seeds": f"""WITH d AS (SELECT doc_id AS id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS name, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT d.* FROM d JOIN embeddings ON vec_id = id), n AS (SELECT id, name AS term FROM c WHERE length(name) >= 3 AND NOT list_contains({nlp.GENERIC}, name)),
q AS (SELECT vec_id AS query_id, CASE vec_id % 300 WHEN 0 THEN lower(upper(text)) ELSE '' END AS text FROM embeddings JOIN d ON d.id = vec_id WHERE vec_id % 100 = 0),
m AS (SELECT DISTINCT query_id, n.id FROM q JOIN n ON contains(q.text, term) AND regexp_matches(q.text, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(term) || '($|[^\\p{{L}}\\p{{N}}_])')
  UNION SELECT query_id, c.id FROM q JOIN c ON c.id = query_id + 1 WHERE query_id % 300 = 100)
SELECT query_id, id, 'mention' AS source FROM m UNION ALL SELECT query_id, item_id, 'vector' FROM ({retrieval.ORACLE_SQL["knn_ip_topk"]}) k WHERE query_id IN (SELECT query_id FROM q) AND query_id NOT IN (SELECT query_id FROM m)""",
    "crossing_masters": "SELECT c.client_id, c.master_id, c.source AS from_group, m.source AS to_group FROM clients c JOIN clients m ON m.client_id = c.master_id WHERE c.source <> m.source",
    "label_matches": """WITH q AS (SELECT vendor_id AS query_id, regexp_replace(lower(substr(string_split(name, ' ')[-1], 1, 5)), '[^a-z0-9ก-๙]', '', 'g') AS k FROM vendors),
l AS (SELECT client_id AS id, regexp_replace(lower(unnest([name, email])), '[^a-z0-9ก-๙]', '', 'g') AS l FROM clients)
SELECT DISTINCT query_id, id, 'part' AS "by" FROM q JOIN l ON contains(l, k) WHERE length(k) >= 2""",
    "kept_breaks": r"""WITH m AS (SELECT doc_id, nfc_normalize(replace(text, ', ', ',' || chr(8203) || chr(9) || ' ') || ' ' || chr(10) || ' ' || chr(10) || chr(10) || ' end') AS s FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(s, chr(8204), chr(8203)), chr(8205), chr(8203)), chr(65279), ''), '[\t\f\x0B ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS s FROM m),
e AS (SELECT doc_id, regexp_replace(s, '^[\s\p{Z}\x1C-\x1F\x{85}]+|[\s\p{Z}\x1C-\x1F\x{85}]+$', '', 'g') AS s FROM n)
SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM e""",
}
QUERIES |= {name: globals()[name] for name in ("question_seeds", "crossing_masters", "label_matches", "kept_breaks")}

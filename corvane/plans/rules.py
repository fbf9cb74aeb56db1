"""Queries of the assistant's rules: cleaning, phrases, fields, aliases, intents, catalogue kinds, answers, draws.

Their inputs are rendered from the driver's tables by one statement that Spark and the SQL side share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import chunking, metrics, nlp, ranking, shop

from .tables import table

NAMES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")


def rendered(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    used = {n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in statement}
    return spark.sql(statement, **used)


def shared(statement: str) -> str:
    for n in NAMES:
        statement = statement.replace("{" + n + "}", n)
    return statement


def words_sql(text: str, words: list[str]) -> str:
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)')"


def kinds_sql(text: str, kinds: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {words_sql(text, [k, *v])} THEN '{k}' END" for k, v in kinds.items()) + "], lambda k: k IS NOT NULL)"


ORACLE_SQL: dict[str, str] = {}
QUERIES: dict = {}


def registered(sql: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return add


# -- texts

DIRTY = "SELECT p_partkey AS id, concat('  ', upper(p_name), chr(160), chr(9), p_brand, '   1,', CAST(p_size + 100 AS STRING), ',000', chr(10), chr(10), chr(10), chr(10), ' ๑๒ looong ', chr(8203), 'https://x.example/a?b=1 end  ') AS text FROM {part}"
#: chr(8203) is a byte in Spark, so the zero-width space is joined here as text.
DIRTY = DIRTY.replace("chr(8203)", "'​'").replace("chr(160)", "' '")


@registered(f"""WITH d AS ({shared(DIRTY)}) SELECT id,
substr(trim(regexp_replace(replace(text, ' ', ' '), '[ \\t\\r\\n\\f]+', ' ', 'g')), 1, 30) AS cleaned,
trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '​', ''), 'https?://[^ \\t\\r\\n]+', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ') AS scrubbed,
trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(translate(lower(text), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '​', ''), ' ', ' '), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), 'looong', 'long'), '[^a-z0-9_ก-๙\\s.<>=-]', ' ', 'g'), '[\\s]+', ' ', 'g'), ' .-') AS normal,
regexp_replace(lower(text), '[^a-z0-9ก-๙]', '', 'g') AS squeezed FROM d""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned with a cap, scrubbed, normalised, compact."""
    x = F.col("text")
    return rendered(spark, sf_dir, DIRTY).select("id", t.clean(x, 30).alias("cleaned"), t.scrub(x).alias("scrubbed"), t.normalised(x).alias("normal"), t.compact(x).alias("squeezed"))


PHRASES = "SELECT p_partkey AS id, concat('tell me about the ', p_name, ' vs ', p_brand, ' [S', CAST(p_size AS STRING), '] and [S2] [S2] please 1. first 2) second') AS text, p_name AS name FROM {part}"
TRIGGERS = {"ring": ["band", "loop"], "red": ["crimson"]}


@registered(f"""WITH p AS ({shared(PHRASES)}) SELECT id,
trim(regexp_replace(replace(replace(text, 'tell me about', ''), 'please', ''), ' +', ' ', 'g')) AS subject,
CASE WHEN name LIKE '%widget%' OR name LIKE '%red%' THEN CASE WHEN name LIKE 'red%' THEN 'red' WHEN name LIKE '%widget%' THEN 'widget' END END AS phrase,
CASE WHEN text LIKE '%ring%' OR text LIKE '%red%' THEN text || ' ' || array_to_string(list_concat(CASE WHEN text LIKE '%ring%' THEN ['band', 'loop'] ELSE [] END, CASE WHEN text LIKE '%red%' THEN ['crimson'] ELSE [] END), ' ') ELSE text END AS expanded,
trim(split_part(text, ' vs ', 1)) AS one, trim(split_part(text, ' vs ', 2)) AS other,
array_to_string(CASE WHEN regexp_extract(text, '\\[(S[0-9]+)\\]', 1) = 'S2' THEN ['S2'] ELSE [regexp_extract(text, '\\[(S[0-9]+)\\]', 1), 'S2'] END, ',') AS cited,
trim(regexp_replace(regexp_replace(text, '\\[S[0-9]+\\]', '', 'g'), ' +', ' ', 'g')) AS uncited,
regexp_replace(text, ' +([0-9]+[.)] )', chr(10) || '\\1', 'g') AS reflowed FROM p""")
def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, T16, T24, T26, T28, T41, T44."""
    x = F.col("text")
    sides = t.comparison(x)
    return rendered(spark, sf_dir, PHRASES).select(
        "id",
        t.without(x, ["tell me about", "please"]).alias("subject"),
        t.first_phrase(F.col("name"), ["widget", "red"]).alias("phrase"),
        nlp.expanded(x, TRIGGERS).alias("expanded"),
        sides[0].alias("one"),
        sides[1].alias("other"),
        F.array_join(t.citations(x), ",").alias("cited"),
        t.without_citations(x).alias("uncited"),
        t.source_markers(x).alias("reflowed"),
    )


FIELDS = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CAST(p_size AS INT) AS size, CAST(p_partkey AS DOUBLE) AS key FROM {part}"


@registered(f"""WITH f AS ({shared(FIELDS)}) SELECT id, size * 1000.0 AS thousands, size * 10000.0 AS tens, size + 0.5 AS plain,
[replace(name, ' ', '-'), 'x y'] AS tags, [name, brand] AS piped, '{{"a": ' || size || '}}' AS fenced, id::VARCHAR AS key, brand AS trimmed,
size % 2 = 0 AS flag, CASE WHEN size > 0 THEN size / 100.0 END AS price, [name, brand, 'c', 'd'] AS path, [name, brand] AS spelled,
CASE WHEN brand = 'Brand#1' THEN 'Acme' ELSE brand END AS maker, CASE WHEN size % 2 = 0 THEN 'two' ELSE brand END AS local FROM f""")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14, T31, T33, T35, T36, T46, T53, K5, K6, R1."""
    size, name, brand = F.col("size").cast("string"), F.col("name"), F.col("brand")
    known = nlp.reconciled_brand(brand, F.concat(F.lit("Acme by "), brand), F.when(brand == "Brand#1", F.lit("https://x.example/acme-shop")).otherwise(F.lit("https://x.example/shop")), ["Acme", "Other"])
    local = F.array(F.struct(F.lit("en").alias("lang"), brand.alias("value")), F.struct(F.lit("th").alias("lang"), F.when(F.col("size") % 2 == 0, F.lit("two")).otherwise(F.lit(" ")).alias("value")))
    return rendered(spark, sf_dir, FIELDS).select(
        "id",
        t.amount(F.concat(F.lit("about "), size, F.lit("k"))).alias("thousands"),
        t.amount(F.concat(size, F.lit(" หมื่น"))).alias("tens"),
        t.amount(F.concat(size, F.lit(".5"))).alias("plain"),
        t.tag_list(F.concat(F.lit("['"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("', 'x y', '']"))).alias("tags"),
        t.tag_list(F.concat(name, F.lit(" | "), brand, F.lit("|"))).alias("piped"),
        t.fenced_json(F.concat(F.lit('```json\n{"a": '), size, F.lit("}\n```"))).alias("fenced"),
        t.key_text(F.col("key")).alias("key"),
        t.key_text(F.concat(F.lit(" "), brand, F.lit(" "))).alias("trimmed"),
        t.boolean(F.when(F.col("size") % 2 == 0, F.lit("InStock")).otherwise(F.lit("no"))).alias("flag"),
        nlp.minor_price(F.array(F.lit(0), F.lit(-5), F.col("size"))).alias("price"),
        t.path_parts(F.concat_ws(" > ", name, brand, F.lit("c"), F.lit(""), F.lit("d"), F.lit("e"))).alias("path"),
        t.distinct_ignoring_case(F.array(name, brand, F.upper(name), F.lower(brand))).alias("spelled"),
        known.alias("maker"),
        nlp.localised(local, "th").alias("local"),
    )


ALIASES = [("ring", "ring"), ("the band", "ring"), ("gear", "gear"), ("gear wheel", "gear"), ("อุปกรณ์", "kit"), ("rod", "rod")]
ASKED = "SELECT p_partkey AS query_id, CASE WHEN p_size % 3 = 0 THEN concat('the band of ', p_name, 's') WHEN p_size % 3 = 1 THEN concat('Gear Wheel, ', p_name) ELSE concat('ชุดอุปกรณ์ ', p_name, '.5') END AS text FROM {part}"


@registered(f"""WITH q AS ({shared(ASKED)}), a(alias, canonical) AS (VALUES {', '.join(f"('{a}', '{c}')" for a, c in ALIASES)}),
h AS (SELECT query_id, canonical, alias, row_number() OVER (PARTITION BY query_id, canonical ORDER BY length(alias) DESC, alias) AS n FROM q, a
  WHERE CASE WHEN regexp_matches(alias, '^[a-z0-9 .&-]+$') THEN regexp_matches(lower(text), '(^|[^a-z0-9])' || alias || '($|[^a-z0-9.]|[.]($|[^0-9]))') ELSE contains(lower(text), alias) END)
SELECT query_id, canonical, alias, 1.0 AS score FROM h WHERE n = 1""")
def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias of each canonical name, by script."""
    return nlp.alias_matches(rendered(spark, sf_dir, ASKED), spark.createDataFrame(ALIASES, "alias string, canonical string"))


MESSAGES = "SELECT p_partkey AS id, CASE CAST(p_size % 6 AS INT) WHEN 0 THEN 'Hello there' WHEN 1 THEN concat('any PROMOTION on ', p_name) WHEN 2 THEN concat('list all ', p_name, 's') WHEN 3 THEN concat('recommend a ', p_name) WHEN 4 THEN concat('contact ', p_brand) ELSE 'weather today' END AS text, CAST(p_size % 4 AS INT) AS fuzzy FROM {part}"
INTENTS = [("greeting", "^(hi|hello)"), ("promotion", "promotion|discount"), ("list", "list all|every"), ("discovery", "recommend|suggest"), ("contact", "contact|phone")]


@registered(f"""WITH m AS ({shared(MESSAGES)}), i AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in INTENTS)} ELSE 'unknown' END AS intent FROM m)
SELECT id, intent, CASE WHEN regexp_matches(lower(text), 'ring|rod|gear|promotion') THEN intent ELSE 'off_topic' END AS guarded, round(least(0.99, 0.72 + 0.045 * 5 - 0.05 * fuzzy), 6) AS confidence FROM i""")
def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question classes, greeting, domain guard, confidence."""
    found = rendered(spark, sf_dir, MESSAGES).withColumn("intent", nlp.intent(F.col("text"), INTENTS))
    return found.select("id", "intent", nlp.guarded(F.col("intent"), F.col("text"), "ring|rod|gear|promotion", "off_topic").alias("guarded"), F.round(nlp.confidence(F.lit(5), F.col("fuzzy")), 6).alias("confidence"))


NAMED = "SELECT p_partkey AS id, concat(p_name, ' mark ', CAST(p_partkey AS STRING)) AS name FROM {part}"
NAMED_Q = "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 200 = 0 THEN concat('price of ', p_name, ' mark ', CAST(p_partkey AS STRING), ' today') ELSE concat(CAST(p_partkey AS STRING), ' ', p_name, ' mark') END AS text FROM {part} WHERE p_partkey % 100 = 0"


@registered(f"""WITH p AS ({shared(NAMED)}), q AS ({shared(NAMED_Q)}), tp AS (SELECT id, lower(name) AS n, regexp_extract_all(lower(name), '[a-z0-9]+') AS t FROM p), tq AS (SELECT query_id, lower(text) AS q, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM q),
s AS (SELECT query_id, id, n, CASE WHEN contains(q, n) THEN 2 + length(n) / length(q) WHEN len(list_intersect(tp.t, tq.t)) / len(list_distinct(tp.t)) >= 0.75 THEN len(list_intersect(tp.t, tq.t)) / len(list_distinct(tp.t)) END AS score FROM tp, tq),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC) AS r FROM s WHERE score IS NOT NULL)
SELECT query_id, min(id) AS id, round(any_value(score), 6) AS score FROM r WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT n) = 1""")
def named_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one product that a query names, none on ties of different names."""
    return nlp.named_product(rendered(spark, sf_dir, NAMED), rendered(spark, sf_dir, NAMED_Q))


# -- folds and lists

TURNS = "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size FROM {conversations}"


@registered(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, size) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM ({shared(TURNS)})),
f AS (SELECT conv_id, turn, n, total, least(greatest(0, 600 // total - 20), size) AS allowed, 600 - CASE WHEN least(greatest(0, 600 // total - 20), size) > 0 THEN least(greatest(0, 600 // total - 20), size) + 20 ELSE 0 END AS left_ FROM t WHERE n = 1
UNION ALL SELECT t.conv_id, t.turn, t.n, t.total, least(greatest(0, f.left_ // (t.total - t.n + 1) - 20), t.size), f.left_ - CASE WHEN least(greatest(0, f.left_ // (t.total - t.n + 1) - 20), t.size) > 0 THEN least(greatest(0, f.left_ // (t.total - t.n + 1) - 20), t.size) + 20 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1)
SELECT conv_id, turn, allowed FROM f""")
def shared_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's equal share of what is left."""
    return nlp.shared_budget(rendered(spark, sf_dir, TURNS), ["conv_id"], "turn", "size", 600, 20)


LINES = "SELECT o_custkey AS doc, CAST(o_orderkey AS BIGINT) AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey % 3 + 1 AS STRING), '.', CAST(o_orderkey % 4 + 1 AS STRING), ' Title') ELSE 'plain 1.2 text' END AS line FROM {orders}"


@registered(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS k, try_cast(nullif(regexp_extract(line, '^\\s*([0-9]+)[.][0-9]+\\s+\\S', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(line, '^\\s*[0-9]+[.]([0-9]+)\\s+\\S', 1), '') AS INT) AS b FROM ({shared(LINES)})),
f AS (SELECT doc, line_no, k, a, b FROM l WHERE k = 1
UNION ALL SELECT l.doc, l.line_no, l.k, CASE WHEN ok THEN l.a ELSE l.pa END, CASE WHEN ok THEN l.b ELSE l.pb END FROM (SELECT l.*, f.a AS pa, f.b AS pb, coalesce(l.a IS NOT NULL AND (f.a IS NULL OR (l.a = f.a AND l.b = f.b + 1) OR (l.a = f.a + 1 AND l.b = 1)), FALSE) AS ok FROM f JOIN l ON l.doc = f.doc AND l.k = f.k + 1) l)
SELECT doc, line_no, CASE WHEN a IS NOT NULL THEN a || '.' || b END AS section FROM f""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings count only where they follow the last one."""
    return nlp.numbered_sections(rendered(spark, sf_dir, LINES), "doc", "line_no", "line")


@registered("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT o_custkey, string_agg('#' || o_orderkey, ', ' ORDER BY n) || CASE WHEN any_value(total) > 3 THEN ', and ' || (any_value(total) - 3) || ' more' ELSE '' END AS line FROM r WHERE n <= 3 GROUP BY 1""")
def bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three and how many more."""
    orders = table(spark, sf_dir, "orders").withColumn("_text", F.concat(F.lit("#"), F.col("o_orderkey").cast("string")))
    return ranking.listed(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "_text", 3)


# -- catalogue rules

CONCEPTS = {"ring": ["rings"], "gear": ["gears", "gizmo"], "plate": ["plates", "anvil"]}
SUBTYPES = {"old": ["vintage"], "hot": ["heated"]}
ASKED_PARTS, MADE_PARTS = {"small part": ["small"]}, {"small part": ["small", "promo"]}
REQUESTS = [(1, "a vintage ring"), (2, "Gizmo or gear"), (3, "small plates"), (4, "anything")]
GOODS = "SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS leaf, concat(p_name, ' ', lower(p_type)) AS name, p_brand AS brand FROM {part}"
REQUEST_SQL = ", ".join(f"({i}, '{r}')" for i, r in REQUESTS)


@registered(f"""WITH g AS ({shared(GOODS)}), q(request, asked) AS (VALUES {REQUEST_SQL}),
k AS (SELECT *, {kinds_sql("asked", CONCEPTS)} AS wanted, {kinds_sql("leaf", CONCEPTS)} AS own, {kinds_sql("name", CONCEPTS)} AS named, {kinds_sql("asked", SUBTYPES)} AS sub, {kinds_sql("name", SUBTYPES)} AS own_sub, {kinds_sql("asked", ASKED_PARTS)} AS part, {kinds_sql("name", MADE_PARTS)} AS own_part FROM g, q)
SELECT request, id, CASE WHEN len(wanted) = 0 OR list_has_any(own, wanted) THEN TRUE WHEN len(own) > 0 THEN FALSE ELSE list_has_any(named, wanted) END AS category,
len(sub) = 0 OR list_has_any(own_sub, sub) AS subtype, CASE WHEN len(part) > 0 THEN list_has_any(own_part, part) ELSE len(own_part) = 0 END AS accessory,
(starts_with(leaf, 'r') OR starts_with(leaf, 'g')) AND NOT {words_sql("name", ["old", "economy"])} AS base FROM k""")
def catalogue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, subtype, accessory and base identity of each product for each request."""
    asked = ranking.sent(spark.createDataFrame(REQUESTS, "request int, asked string"))
    leaf, name, want = F.col("leaf"), F.col("name"), F.col("asked")
    found = {
        "category": shop.category_matches(leaf, name, want, CONCEPTS),
        "subtype": shop.subtype_matches(name, want, SUBTYPES),
        "accessory": shop.accessory_matches(name, want, ASKED_PARTS, MADE_PARTS),
        "base": shop.base_identity(leaf, name, ["r", "g"], ["old", "economy"]),
    }
    goods = rendered(spark, sf_dir, GOODS)
    return shop.judged_once(goods, ["leaf", "name"], lambda texts: texts.crossJoin(asked).withColumns(found)).select("request", "id", *found)


BRANDS = {"Brand#2": ["Zwei", "Brand Two"], "Brand#11": ["Eleven"]}
WANTED = [(1, "brand #2"), (2, "ZWEI"), (3, "eleven"), (4, "Brand#25 Ltd"), (5, "")]


@registered(f"""WITH g AS ({shared(GOODS)}), w(request, wanted) AS (VALUES {', '.join(f"({i}, '{b}')" for i, b in WANTED)}),
c AS (SELECT *, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS own, regexp_replace(lower(wanted), '[^a-z0-9]', '', 'g') AS target FROM g, w),
n AS (SELECT *, CASE WHEN target IN ('brand2', 'zwei', 'brandtwo') THEN ['brand2', 'zwei', 'brandtwo'] WHEN target IN ('brand11', 'eleven') THEN ['brand11', 'eleven'] ELSE [target] END AS names FROM c)
SELECT request, id, own <> '' AND len(list_filter(names, lambda x: x <> '' AND (contains(own, x) OR contains(x, own)))) > 0 AS same FROM n""")
def brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 without the fuzzy rule, which SQL lacks."""
    rows = rendered(spark, sf_dir, GOODS).crossJoin(ranking.sent(spark.createDataFrame(WANTED, "request int, wanted string")))
    return rows.select("request", "id", shop.brand_matches(F.col("brand"), F.col("wanted"), BRANDS, fuzzy=None).alias("same"))


FEATURES = {"shiny": ["bright", "glossy"], "heavy duty": ["industrial"]}
WISHES = "SELECT p_partkey AS id, concat('Good ', CASE WHEN p_size % 2 = 0 THEN 'glossy ' ELSE 'industrial bright ' END, p_name, ' x') AS text, concat(p_name, ' ', lower(p_type), CASE WHEN p_size % 4 = 0 THEN ' shiny' ELSE ' heavy duty bright' END) AS name FROM {part}"


@registered(f"""WITH w AS ({shared(WISHES)}), g AS (SELECT *, regexp_extract_all(replace(replace(replace(lower(text), 'glossy', ' '), 'industrial', ' '), 'bright', ' '), '[a-z0-9]+') AS rest FROM w),
k AS (SELECT *, list_filter(list_distinct(rest), lambda x: x <> 'good' AND length(x) >= 2) AS plain FROM g)
SELECT id, len(plain) + CASE WHEN text LIKE '%industrial%' THEN 2 ELSE 1 END AS groups,
(contains(name, 'shiny') OR contains(name, 'bright') OR contains(name, 'glossy')) AND (text NOT LIKE '%industrial%' OR contains(name, 'heavy duty') OR contains(name, 'industrial')) AND len(list_filter(plain, lambda x: NOT contains(name, x))) = 0 AS met FROM k""")
def wish_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wish as groups of alternatives, each of which a product must meet."""
    rows = rendered(spark, sf_dir, WISHES).withColumn("g", shop.query_groups(F.col("text"), FEATURES, ["good"]))
    return rows.select("id", F.size("g").cast("long").alias("groups"), shop.meets(F.col("g"), F.col("name")).alias("met"))


COMMANDS = "SELECT p_partkey AS id, concat('Please show please me find ', p_name, ' from ', p_brand, ' under ', CAST(p_size AS STRING), '00 now') AS text FROM {part}"
FILLERS = ["please", "show me", "find", "now", "from"]
STEP = "trim(regexp_replace(regexp_replace(X, '(^|[^a-z])(show me|please|find|from|now)([^a-z]|$)', '\\1\\3', 'g'), ' +', ' ', 'g'))"
NESTED = "lower(free)"
for _ in range(12):
    NESTED = STEP.replace("X", NESTED)


@registered(f"""WITH c AS ({shared(COMMANDS)}), b AS (SELECT id, regexp_extract(text, 'under ([0-9]+)', 1)::DOUBLE AS high, regexp_extract(text, '(Brand#[0-9]+)', 1) AS brand, regexp_replace(regexp_replace(text, 'under [0-9]+', ' ', 'g'), 'Brand#[0-9]+', ' ', 'g') AS free FROM c)
SELECT id, high, brand, {NESTED} AS residual FROM b""")
def command_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and brands claim their spans, fillers go until nothing changes, the rest is the search text."""
    x = F.col("text")
    free = shop.claimed(shop.claimed(x, "under [0-9]+"), "Brand#[0-9]+")
    return rendered(spark, sf_dir, COMMANDS).select("id", F.regexp_extract(x, "under ([0-9]+)", 1).cast("double").alias("high"), F.regexp_extract(x, "(Brand#[0-9]+)", 1).alias("brand"), shop.residual(free, FILLERS).alias("residual"))


THAI = "SELECT p_partkey AS id, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'ไก่ทอด ใจ' WHEN 1 THEN 'บักเก็ต' WHEN 2 THEN 'เมนู ซอส' WHEN 3 THEN concat('สลัด ', p_name) ELSE p_name END AS text FROM {part}"
#: Letters of one sound at the end of a word, and vowels written before their consonant.
FINALS = {"ด": "t", "ต": "t", "จ": "t", "ส": "t", "ญ": "n", "ร": "n", "ล": "n"}
LEADING, MARKS = "เแโใไ", "่้๊๋็์"
FINAL_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FINALS.items())


@registered(f"""WITH x AS ({shared(THAI)}), w AS (SELECT id, list_transform(string_split(translate(lower(text), '{MARKS}', ''), ' '), lambda w: CASE WHEN length(w) > 1 AND contains('{LEADING}', substr(w, length(w) - 1, 1)) THEN w ELSE left(w, length(w) - 1) || CASE right(w, 1) {FINAL_SQL} ELSE right(w, 1) END END) AS w FROM x)
SELECT id, array_to_string(w, ' ') AS sound, replace(translate(array_to_string(w, ' '), 'ศษส', 'ซซซ'), ' ', '') AS typo FROM w""")
def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound of final consonants, and a compact key that folds letters often mistaken."""
    sound = shop.phonetic(F.col("text"), FINALS, MARKS, LEADING)
    return rendered(spark, sf_dir, THAI).select("id", sound.alias("sound"), F.replace(F.translate(sound, "ศษส", "ซซซ"), F.lit(" "), F.lit("")).alias("typo"))


QUESTIONS = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_size % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_retailprice END AS price, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN concat('do you have ', p_name) WHEN 1 THEN 'details of nothing' WHEN 2 THEN 'which promotion' WHEN 3 THEN 'list all' ELSE 'hm' END AS text, CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'what is the price' WHEN 1 THEN 'who is the maker' ELSE 'tell' END AS asked, CAST(p_size AS DOUBLE) / 100 AS score FROM {part}"


@registered(f"""WITH q AS ({shared(QUESTIONS)}) SELECT id, CASE WHEN contains(text, name) THEN 'explicit' WHEN text LIKE 'details of %' THEN 'detail' WHEN contains(text, 'promotion') THEN 'promotion' WHEN contains(text, 'list all') THEN 'list' WHEN score >= 0.13 THEN 'ranked' ELSE 'none' END AS branch,
CASE WHEN contains(text, name) THEN name WHEN text LIKE 'details of %' THEN 'no such item' WHEN contains(text, 'promotion') THEN 'promotions' WHEN contains(text, 'list all') THEN 'all items' WHEN score >= 0.13 THEN name ELSE 'not found' END AS answer,
CASE WHEN contains(asked, 'price') THEN CASE WHEN price IS NOT NULL THEN price::VARCHAR ELSE 'unknown' END WHEN contains(asked, 'maker') THEN brand ELSE 'unknown' END AS field FROM q""")
def answer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first branch that has an answer, and the field that a question's keyword names."""
    x, name = F.col("text"), F.col("name")
    branches = [("explicit", F.contains(x, name), name), ("detail", x.startswith("details of "), F.lit("no such item")), ("promotion", shop.held(x, ["promotion"]), F.lit("promotions")), ("list", F.contains(x, F.lit("list all")), F.lit("all items")), ("ranked", F.col("score") >= 0.13, name)]
    rows = rendered(spark, sf_dir, QUESTIONS).withColumn("c", shop.cascade(branches, "not found"))
    return rows.select("id", "c.branch", "c.answer", shop.field_answer(F.col("asked"), [(["price", "cost"], F.col("price")), (["maker", "brand"], F.col("brand"))], F.lit("unknown")).alias("field"))


@registered("""WITH t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part), topic(topic, word) AS (VALUES ('metal', 'ring'), ('metal', 'rod'), ('metal', 'bolt'), ('machine', 'gear'), ('machine', 'gizmo'))
SELECT topic, count(DISTINCT id) AS items, min(id) AS first FROM t JOIN topic USING (word) GROUP BY 1""")
def topic_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each topic, by the words that the topic expands to."""
    topics = ranking.sent(spark.createDataFrame([("metal", "ring"), ("metal", "rod"), ("metal", "bolt"), ("machine", "gear"), ("machine", "gizmo")], "topic string, word string"))
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(t.tokens(F.col("p_name")))).alias("word"))
    return words.join(topics, "word").groupBy("topic").agg(F.count_distinct("id").alias("items"), F.min("id").alias("first"))


MENU_ROWS = "SELECT l_orderkey AS menu, l_linenumber AS pos, l_partkey AS id, CASE WHEN l_quantity > 45 THEN '' ELSE concat('item ', CAST(l_partkey AS STRING)) END AS name, CASE WHEN l_discount > 0.08 THEN CAST(NULL AS DOUBLE) ELSE l_extendedprice END AS price, l_returnflag <> 'R' AS visible, l_linestatus AS status, l_returnflag AS flag FROM {lineitem}"


@registered(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY menu, id ORDER BY pos, coalesce(price, -1), name, status, flag) AS n FROM ({shared(MENU_ROWS)}) WHERE visible AND name <> '' AND price IS NOT NULL)
SELECT menu, id, name, price, flag AS components, 'size: ' || status || '/large' AS choices FROM m WHERE n = 1""")
def menu_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested menus as items; single options are components, others choices."""
    groups = F.array(F.struct(F.lit("base").alias("name"), F.array("flag").alias("options")), F.struct(F.lit("size").alias("name"), F.array(F.col("status"), F.lit("large")).alias("options")))
    item = F.struct("id", "name", "price", "visible", groups.alias("groups"))
    # the lines of one order are one menu
    order = F.struct("pos", F.coalesce("price", F.lit(-1.0)).alias("p"), "name", "status", "flag", item.alias("i"))
    menus = rendered(spark, sf_dir, MENU_ROWS).groupBy("menu").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["i"]).alias("items"))
    flat = shop.flattened(menus, "menu", "items")
    one, many = shop.split_choices(F.col("groups"))
    return flat.select("menu", "id", "name", "price", F.array_join(one, ", ").alias("components"), F.array_join(many, ", ").alias("choices"))


DETAILS = """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('{"props":{"pageProps":{"product":{"overview":"', p_name, ' overview"}}}}') END AS page, CASE WHEN p_size % 4 = 0 THEN 'no rating yet' ELSE concat('4.5 / 5 from 1,', CAST(p_size + 100 AS STRING), ' reviews, ', CAST(p_size AS STRING), '% recommend it') END AS line, p_name AS name FROM """
DETAILS_SPARK = DETAILS.replace("{", "{{").replace("}", "}}") + "{part}"


@registered(f"""WITH d AS ({DETAILS}part) SELECT id, coalesce(page->>'$.props.pageProps.product.overview', CASE WHEN id % 2 = 0 THEN name END) AS overview,
CASE WHEN page IS NOT NULL THEN 'structured' WHEN id % 2 = 0 THEN 'rendered' END AS origin, CASE WHEN contains(line, '/ 5') THEN 4.5 END AS rating, try_cast(replace(nullif(regexp_extract(line, '([0-9,]+) reviews', 1), ''), ',', '') AS INT) AS reviews, try_cast(nullif(regexp_extract(line, '([0-9]+)% recommend', 1), '') AS INT) AS recommended FROM d""")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overview from the page's data, else from the rendered page; ratings from its text."""
    rows = spark.sql(DETAILS_SPARK, part=table(spark, sf_dir, "part"))
    structured = rows.select("id", F.get_json_object("page", "$.props.pageProps.product.overview").alias("overview"))
    shown = rows.where("id % 2 = 0").select("id", F.col("name").alias("overview"))
    return shop.enriched(rows.select("id", shop.rating(F.col("line")).alias("r")), structured, shown, "id", "overview").select("id", "overview", "origin", "r.rating", "r.reviews", "r.recommended")


LEFT = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CAST(p_size AS INT) AS size, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind FROM {part}"
RIGHT = "SELECT p_name AS name, p_brand AS brand, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 60 END AS INT) AS size, concat('ref ', CAST(p_partkey AS STRING)) AS kind FROM {part} WHERE p_partkey % 5 < 3"


@registered(f"""WITH l AS ({shared(LEFT)}), r AS ({shared(RIGHT)}), a AS (SELECT name, brand, size, any_value(kind) AS kind FROM r GROUP BY ALL HAVING count(*) = 1), a3 AS (SELECT name, brand, size, any_value(kind) AS kind FROM r GROUP BY name, brand, size HAVING count(*) = 1), a2 AS (SELECT name, brand, any_value(kind) AS kind FROM r GROUP BY name, brand HAVING count(*) = 1)
SELECT l.id, coalesce(nullif(l.kind, ''), a3.kind, a2.kind) AS kind, CASE WHEN a3.kind IS NOT NULL THEN 'full' WHEN a2.kind IS NOT NULL THEN 'less' END AS matched FROM l LEFT JOIN a3 ON a3.name = l.name AND a3.brand = l.brand AND a3.size = l.size LEFT JOIN a2 ON a2.name = l.name AND a2.brand = l.brand""".replace("a AS (SELECT name, brand, size, any_value(kind) AS kind FROM r GROUP BY ALL HAVING count(*) = 1), ", ""))
def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By three fields, else by two, unique keys only; missing fields are filled."""
    return shop.fallback_join(rendered(spark, sf_dir, LEFT), rendered(spark, sf_dir, RIGHT), ["name", "brand", "size"], ["name", "brand"], ["kind"]).select("id", "kind", "matched")


POOL = "SELECT brand, id, rank FROM (SELECT p_brand AS brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM {part}) AS x WHERE rank <= 15"
POOL_SQL = shared(POOL)


@registered(f"""WITH pool AS ({POOL_SQL}), hist AS (SELECT brand, 1 AS at, list(id ORDER BY id) FILTER (rank <= 3) AS ids FROM pool GROUP BY 1 UNION ALL SELECT brand, 2, list(id ORDER BY id) FILTER (rank BETWEEN 2 AND 4) FROM pool GROUP BY 1),
shown AS (SELECT brand, id, count(*) AS shown FROM (SELECT brand, unnest(ids) AS id FROM hist) GROUP BY 1, 2), r AS (SELECT p.*, coalesce(shown, 0) AS shown FROM pool p LEFT JOIN shown USING (brand, id)),
d AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY shown, md5('7:' || id), id) AS place FROM r),
g AS (SELECT brand, list(id ORDER BY id) FILTER (place <= 3) AS chosen, arg_max(id, (shown, -id)) FILTER (place <= 3) AS leaving, arg_min(id, (shown, id)) FILTER (place > 3) AS coming FROM d GROUP BY 1),
s AS (SELECT brand, list(DISTINCT list_sort(ids)) AS sets FROM hist GROUP BY 1),
c AS (SELECT brand, chosen, list_sort(list_append(list_filter(chosen, lambda x: x <> leaving), coming)) AS other, coming, sets FROM g LEFT JOIN s USING (brand)),
f AS (SELECT brand, unnest(CASE WHEN list_contains(sets, chosen) AND coming IS NOT NULL AND NOT list_contains(sets, other) THEN other ELSE chosen END) AS id FROM c)
SELECT d.brand, d.id, d.rank, d.shown FROM d JOIN f USING (brand, id)""")
def fair_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least shown first, by a seeded hash; a set shown before swaps one member."""
    pool = rendered(spark, sf_dir, POOL)
    first = pool.groupBy("brand").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.col("id")))).alias("ids")).withColumn("at", F.lit(1))
    second = pool.groupBy("brand").agg(F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 4), F.col("id")))).alias("ids")).withColumn("at", F.lit(2))
    return shop.fair_draw(pool, first.unionByName(second), ["brand"], "rank", "id", 3, 7)


# -- scores, geometry, evaluation

VECTORS = "SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity AS q, l_discount * 100 AS d, l_tax * 100 AS x FROM {lineitem}"


@registered(f"""WITH v AS (SELECT *, greatest(q, d, x) AS top FROM ({shared(VECTORS)})), e AS (SELECT *, exp((q - top) / 5) + exp((d - top) / 5) + exp((x - top) / 5) AS z FROM v)
SELECT o, n, p, round(exp((q - top) / 5) / z, 6) AS first, CASE WHEN q = top THEN 'q' WHEN d = top THEN 'd' ELSE 'x' END AS best FROM e""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: shares by softmax with a temperature, and the best label."""
    scores = F.array("q", "d", "x")
    rows = rendered(spark, sf_dir, VECTORS).withColumn("s", shop.softmax(scores, 5.0))
    return rows.select("o", "n", "p", F.round(F.col("s")[0], 6).alias("first"), F.element_at(F.array(F.lit("q"), F.lit("d"), F.lit("x")), F.array_position(scores, F.array_max(scores)).cast("int")).alias("best"))


BOXES = "SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity AS a, l_discount * 100 AS b, l_quantity + 10 AS c, l_discount * 100 + 5 AS d FROM {lineitem}"


@registered(f"""SELECT o, n, p, round(greatest(0, least(c, 30) - greatest(a, 20)) * greatest(0, least(d, 12) - greatest(b, 4)) / ((c - a) * (d - b)), 6) AS inside FROM ({shared(BOXES)})""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the share of each rectangle that lies in a given one."""
    own, other = [F.col(c) for c in "abcd"], [F.lit(float(x)) for x in (20, 4, 30, 12)]
    return rendered(spark, sf_dir, BOXES).select("o", "n", "p", F.round(shop.overlap_ratio(own, other), 6).alias("inside"))


ATOMS = "SELECT p_partkey AS id, p_type AS intent, CASE WHEN p_size % 9 = 0 THEN 'PROMO' ELSE p_type END AS guess, split(p_name, ' ') AS gold, CASE WHEN p_size % 5 = 0 THEN array(split_part(p_name, ' ', 1), 'odd') WHEN p_size % 7 = 0 THEN array() ELSE split(p_name, ' ') END AS found FROM {part}"
ATOMS_SQL = "SELECT p_partkey AS id, p_type AS intent, CASE WHEN p_size % 9 = 0 THEN 'PROMO' ELSE p_type END AS guess, string_split(p_name, ' ') AS gold, CASE WHEN p_size % 5 = 0 THEN [split_part(p_name, ' ', 1), 'odd'] WHEN p_size % 7 = 0 THEN [] ELSE string_split(p_name, ' ') END AS found FROM part"


@registered(f"""WITH a AS ({ATOMS_SQL}), s AS (SELECT avg((intent = guess)::INT) AS i, sum(len(list_intersect(gold, found))) AS hit, sum(len(found)) AS f, sum(len(gold)) AS g, avg((intent = guess AND list_sort(gold) = list_sort(found))::INT) AS j FROM a),
m AS (SELECT *, CASE WHEN f = 0 THEN 1.0 ELSE hit / f END AS p, CASE WHEN g = 0 THEN 1.0 ELSE hit / g END AS r FROM s)
SELECT round(i, 6) AS intent_accuracy, round(p, 6) AS atom_precision, round(r, 6) AS atom_recall, round(2 * p * r / (p + r), 6) AS atom_f1, round(j, 6) AS joint_accuracy, i > 0.85 AND j > 0.85 AS passed FROM m""")
def joint_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents, atoms (1 where there are none), both at once, and a strict gate."""
    return metrics.joint(rendered(spark, sf_dir, ATOMS), "intent", "guess", "gold", "found", 0.85)


@registered("""WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, avg((value >= 50)::INT) AS hit FROM events GROUP BY 1)
SELECT event_type, '| ' || event_type || ' | ' || n || ' | ' || printf('%.2f', floor(mean * 100) / 100) || ' | ' || CASE WHEN hit >= 0.5 THEN 'yes' ELSE 'no' END || ' |' AS row FROM s""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown row of each run: count, mean, whether it reached half."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") >= 50).cast("int")).alias("hit"))
    return s.select("event_type", metrics.markdown_row(F.col("event_type"), F.col("n"), F.format_string("%.2f", F.floor(F.col("mean") * 100) / 100), F.when(F.col("hit") >= 0.5, "yes").otherwise("no")).alias("row"))


@registered("""WITH r AS (SELECT p_partkey AS id, p_size / 50.0 AS dense, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size / 10.0 END AS sparse, p_size % 4 = 0 AS named FROM part)
SELECT id, dense < 0.18 AND sparse <= 0 AS low, greatest(dense, sparse) AS best, 0.5 + CASE WHEN named THEN 0.3 ELSE 0.0 END + 0.2 * dense AS relevance, CASE WHEN sparse > 0 AND dense > 0 THEN 'hybrid' WHEN sparse > 0 THEN 'bm25' ELSE 'dense' END AS mode, 'query: ' || id AS prompt FROM r""")
def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low signal, the better of two scores, structural score, mode, prefix."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("dense"), F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_size") / 10.0).alias("sparse"), (F.col("p_size") % 4 == 0).alias("named"))
    mode = F.when((F.col("sparse") > 0) & (F.col("dense") > 0), "hybrid").when(F.col("sparse") > 0, "bm25").otherwise("dense")
    return rows.select("id", ((F.col("dense") < 0.18) & (F.col("sparse") <= 0)).alias("low"), F.greatest("dense", "sparse").alias("best"), (0.5 + F.when(F.col("named"), 0.3).otherwise(0.0) + 0.2 * F.col("dense")).alias("relevance"), mode.alias("mode"), F.concat(F.lit("query: "), F.col("id").cast("string")).alias("prompt"))


PARENTS = "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS size FROM {conversations}"


@registered(f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, size) AS k FROM (SELECT conv_id, turn, CASE WHEN turn % 6 < 4 THEN 'a' ELSE 'b' END AS role, size FROM ({shared(PARENTS)}))),
f AS (SELECT conv_id, turn, role, size AS used, k, 0 AS parent FROM u WHERE k = 1
UNION ALL SELECT u.conv_id, u.turn, u.role, CASE WHEN u.role <> f.role OR f.used + u.size > 500 THEN u.size ELSE f.used + u.size END, u.k, f.parent + CASE WHEN u.role <> f.role OR f.used + u.size > 500 THEN 1 ELSE 0 END FROM f JOIN u ON u.conv_id = f.conv_id AND u.k = f.k + 1)
SELECT conv_id, turn, parent FROM f""")
def parent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns in parents of bounded size."""
    turns = rendered(spark, sf_dir, PARENTS).withColumn("role", F.when(F.col("turn") % 6 < 4, "a").otherwise("b"))
    return chunking.parent_blocks(turns, "conv_id", "turn", "role", "size", 500)


SECTIONS = "SELECT p_partkey AS id, concat(CAST(CAST(p_partkey % 3 + 1 AS INT) AS STRING), '.', CAST(p_size AS STRING)) AS section, concat('หน้า ', CAST(p_size AS STRING), ' of doc') AS label FROM {part}"


@registered(f"""SELECT id, section, row_number() OVER (ORDER BY split_part(section, '.', 1)::INT, split_part(section, '.', 2)::INT, id) AS place, try_cast(nullif(regexp_extract(label, 'หน้า ([0-9]+)', 1), '') AS INT) AS page, CASE WHEN split_part(section, '.', 1)::INT BETWEEN 1 AND 2 THEN split_part(section, '.', 1)::INT END AS chapter FROM ({shared(SECTIONS)}) QUALIFY place <= 41""")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric order of dotted numbers, one row beyond the limit, page labels, chapters in range."""
    rows = rendered(spark, sf_dir, SECTIONS)
    part = lambda i: F.split_part("section", F.lit("."), F.lit(i)).cast("int")
    first = rows.orderBy(part(1), part(2), "id").limit(41)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(part(1), part(2), "id")))
    return placed.select("id", "section", F.col("place").cast("long").alias("place"), F.regexp_extract("label", "หน้า ([0-9]+)", 1).try_cast("int").alias("page"), F.when(part(1).between(1, 2), part(1)).alias("chapter"))


@registered("""WITH w AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS w FROM part), g AS (SELECT id, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS g FROM w)
SELECT g AS gram, count(*) AS n, count(DISTINCT id) AS df FROM g GROUP BY 1""")
def word_bound_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of character n-grams within words, and how many texts hold each."""
    return metrics.gram_counts(table(spark, sf_dir, "part"), "p_partkey", t.word_ngrams(F.col("p_name")))

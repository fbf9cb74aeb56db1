"""Queries of cleaning, chunking and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text, udfs
from corvane.operators import catalog, chunking
from corvane.sources import html

from .tables import TOKENS, table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(docs(spark, sf_dir), "text", 500, 50).select("doc_id", "chunk_index", "start", F.md5("chunk").alias("chunk"))


def chunk_stride_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(docs(spark, sf_dir), "text", 1300, 250, least=30, redundant_tail=True).select("doc_id", "start", F.length("chunk").alias("long"))


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(docs(spark, sf_dir), "text", 350, 0).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(chunking.lines(docs(spark, sf_dir), "text").select("doc_id", "line_no", "line"), "doc_id").select("doc_id", "start_line", "end_line", F.md5("chunk").alias("chunk"))


def chunk_ids_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.windows(docs(spark, sf_dir), "text", 500, 50)
    return chunks.select("doc_id", "chunk_index", text.stable_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")).alias("chunk_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lines(docs(spark, sf_dir), "text").select("doc_id", "source", "line_no", "line")


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.repeated_lines(lines(spark, sf_dir), "doc_id", "source", share=0.02)


def repeated_line_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark, sf_dir).select("source", F.md5("line").alias("line"), "pages")


def strip_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chunking.without_repeated(lines(spark, sf_dir), repeated(spark, sf_dir), "source")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lines = lines(spark, sf_dir)
    kept = chunking.without_repeated(all_lines, repeated(spark, sf_dir), "source").groupBy("source").agg(F.sum(F.length("line")).alias("kept"))
    total = all_lines.groupBy("source").agg(F.sum(F.length("line")).alias("total"), F.count_distinct("doc_id").alias("documents"))
    return total.join(kept, "source", "left").select("source", "documents", "total", F.round(1 - F.coalesce("kept", F.lit(0)) / F.col("total"), 6).alias("noise"))


def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of at most two words up to each line, as its section."""
    head = F.when(F.size(F.split(F.trim("line"), " ")) <= 2, F.trim("line"))
    return chunking.forward_filled(lines(spark, sf_dir), "doc_id", "line_no", head).select("doc_id", "line_no", F.md5("section").alias("section"))


def islands_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined up to the next one of at most two words."""
    breaks = F.size(F.split(F.trim("line"), " ")) <= 2
    return chunking.joined_lines(lines(spark, sf_dir), "doc_id", breaks).select("doc_id", "island", F.md5("text").alias("text"))


def parent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = lines(spark, sf_dir).withColumn("n", F.length("line"))
    return chunking.parent_blocks(units, "doc_id", "line_no", "source", "n", 1500)


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(text.clean(t)).alias("clean"), F.length(text.clean(t, 200)).alias("cut"), F.md5(text.scrub(t)).alias("scrubbed"), F.md5(text.compact(t)).alias("compact"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram similarity of each product's name and type."""
    part = table(spark, sf_dir, "part")
    a, b = text.character_ngrams(F.lower("p_name")), text.character_ngrams(F.lower("p_type"))
    return part.select("p_partkey", F.round(text.jaccard(a, b), 6).alias("similarity"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(parts).alias("sentences"), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).alias("longest"))


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def length_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length, digits and other non-word characters by quality."""
    both = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("quality").agg(F.round(F.avg(F.length("text")), 4).alias("length"), F.round(F.avg(F.regexp_count("text", F.lit("[0-9]"))), 4).alias("digits"), F.round(F.avg(F.regexp_count("text", F.lit("[^A-Za-z0-9_]"))), 4).alias("others"))


def pattern_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"number": r"\b[0-9]{3,}\b", "email": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "url": r"https?://[^ \n]+", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}
    found = F.explode(F.concat(*[_tagged(k, p) for k, p in kinds.items()]))
    return docs(spark, sf_dir).select("doc_id", found.alias("e")).groupBy("doc_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("e.value").alias("distinct_n"))


def _tagged(kind: str, pattern: str):
    return F.transform(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.https_url(F.col("url")).alias("url"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(html.links(F.col("html"))).alias("links"), F.md5(html.title(F.col("html"))).alias("title"), html.explicitly_empty(F.col("html")).alias("is_empty"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("THB "), F.format_string("%.2f", "p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", text.number(shown).alias("price"))


def dirty_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in one of four ways by key, the last of which is no date."""
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "MMM d, yyyy")).when(kind == 2, F.date_format(d, "dd/MM/yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.dirty_date(written).alias("day"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose cleaned text no smaller id has."""
    return catalog.first_wins(docs(spark, sf_dir), [F.md5(text.clean(F.col("text")))], [F.asc("doc_id")]).select("doc_id", "source")


def path_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import graph

    paths = table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("path")).distinct()
    cut = paths.select(F.expr("slice(path, 1, 2)").alias("path")).distinct().unionAll(paths).distinct()
    return graph.leaves(cut, "path").select(F.array_join("path", " ").alias("path"))


def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(udfs.sequence_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = docs(spark, sf_dir).select("doc_id", F.posexplode(udfs.recursive_split(800, 100)("text")).alias("n", "part"))
    return parts.select("doc_id", "n", F.length("part").alias("long"), F.md5("part").alias("part"))


def price_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices asked for in seven ways beside names of models, sizes and other numbers; some have none."""
    part = table(spark, sf_dir, "part")
    p, n = F.floor("p_retailprice").cast("string"), F.col("p_size").cast("string")
    ways = [
        F.concat(F.lit("phone "), n, F.lit(" and "), n, F.lit(" between "), p, F.lit(" and 2k")), F.concat(F.lit("model "), n, F.lit(" and 16 under "), p), F.concat(F.lit("screen inch 24-27 "), n),
        F.concat(F.lit("keyboard 1k-"), p, F.lit("0 red")), F.concat(F.lit("at least "), p, F.lit(" but below 20k")), F.concat(F.lit("wh-1000xm5 "), p, F.lit(",500 บาท")), F.concat(F.lit("over "), n, F.lit("พัน, max 99,000 for "), n),
    ]
    asked = F.element_at(F.array(*ways), (F.col("p_partkey") % 7 + 1).cast("int"))
    return part.select("p_partkey", udfs.price_range(asked).alias("r")).select("p_partkey", "r.*")


LINES = "lines AS (SELECT doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
REPEATED = f"""{LINES}, counted AS (SELECT DISTINCT source, doc_id, trim(line) AS line FROM lines WHERE trim(line) <> '' AND length(line) <= 100),
pages_of AS (SELECT source, count(DISTINCT doc_id) AS n FROM lines GROUP BY 1),
repeated AS (SELECT source, line, pages FROM (SELECT source, line, count(*) AS pages FROM counted GROUP BY 1, 2) JOIN pages_of USING (source) WHERE pages >= greatest(3, floor(n * 0.02)))"""
KEPT = "kept AS (SELECT * FROM lines l WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE r.source IS NOT DISTINCT FROM l.source AND r.line = trim(l.line)))"


def windows(size: int, overlap: int, tail: bool) -> str:
    last = "length(text) - 1" if tail else f"greatest(length(text) - {overlap} - 1, 0)"
    return f"chunks AS (SELECT doc_id, text, unnest(range(0, {last} + 1, {size - overlap})) AS start FROM documents WHERE length(text) > 0), cut AS (SELECT doc_id, start, start // {size - overlap} AS chunk_index, substr(text, (start + 1)::INT, {size}) AS chunk FROM chunks)"


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: length(s) >= 8)"
GRAMS = "CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) <= 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::INT, 2))) END"
SPACE = r"[ \t\r\n\f\x0B]+"
CLEAN = f"trim(regexp_replace(replace(text, chr(160), ' '), '{SPACE}', ' ', 'g'), ' ')"
PREFIXES = "SELECT DISTINCT path FROM (SELECT string_split(p_type, ' ') AS path FROM part UNION ALL SELECT string_split(p_type, ' ')[1:2] FROM part)"

ORACLE_SQL = {
    "parent_blocks": f"""WITH RECURSIVE {LINES}, u AS (SELECT doc_id, line_no, length(line) AS n FROM lines),
f AS (SELECT doc_id, line_no, n AS used, 0 AS parent FROM u WHERE line_no = 0
UNION ALL SELECT u.doc_id, u.line_no, CASE WHEN f.used + u.n > 1500 THEN u.n ELSE f.used + u.n END, f.parent + CASE WHEN f.used + u.n > 1500 THEN 1 ELSE 0 END FROM f JOIN u ON u.doc_id = f.doc_id AND u.line_no = f.line_no + 1)
SELECT doc_id, line_no, parent FROM f""",
    "price_spans": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS way, floor(p_retailprice) AS p, p_size::DOUBLE AS n FROM part)
SELECT p_partkey, CASE way WHEN 0 THEN least(p, 2000.0) WHEN 3 THEN least(1000.0, p * 10) WHEN 4 THEN p WHEN 6 THEN n * 1000 END AS low,
CASE way WHEN 0 THEN greatest(p, 2000.0) WHEN 1 THEN p WHEN 3 THEN greatest(1000.0, p * 10) WHEN 4 THEN 20000.0 WHEN 5 THEN p * 1000 + 500 WHEN 6 THEN 99000.0 END AS high,
CASE way WHEN 0 THEN TRUE WHEN 3 THEN TRUE WHEN 4 THEN TRUE WHEN 6 THEN FALSE END AS low_inclusive, CASE way WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE WHEN 5 THEN TRUE WHEN 6 THEN TRUE END AS high_inclusive FROM p""",
    "chunk_fixed_overlap": f"WITH {windows(500, 50, False)} SELECT doc_id, chunk_index, start, md5(chunk) AS chunk FROM cut",
    "chunk_stride_min": f"WITH {windows(1300, 250, True)} SELECT doc_id, start, length(chunk) AS long FROM cut WHERE length(trim(chunk, ' ')) >= 30",
    "chunk_blocks": f"WITH {windows(350, 0, False)} SELECT doc_id, chunk_index, md5(chunk) AS chunk FROM cut",
    "chunk_lines": f"""WITH {LINES}, w AS (SELECT doc_id, line_no, string_agg(line, chr(10)) OVER o AS chunk, count(*) OVER o AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT doc_id, line_no AS start_line, line_no + n - 1 AS end_line, md5(chunk) AS chunk FROM w WHERE line_no % 3 = 0 AND (line_no = 0 OR line_no + 2 < total)""",
    "chunk_ids_sha": f"WITH {windows(500, 50, False)} SELECT doc_id, chunk_index, substr(sha256(doc_id::VARCHAR || '|' || chunk_index::VARCHAR || '|' || chunk), 1, 16) AS chunk_id FROM cut",
    "repeated_line_df": f"WITH {REPEATED} SELECT source, md5(line) AS line, pages FROM repeated",
    "strip_repeated_lines": f"WITH {REPEATED}, {KEPT} SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM kept GROUP BY 1",
    "noise_ratio": f"WITH {REPEATED}, {KEPT} SELECT source, documents, total, round(1 - coalesce(k, 0) / total, 6) AS noise FROM (SELECT source, sum(length(line))::BIGINT AS total, count(DISTINCT doc_id) AS documents FROM lines GROUP BY 1) LEFT JOIN (SELECT source, sum(length(line))::BIGINT AS k FROM kept GROUP BY 1) USING (source)",
    "section_ffill": f"WITH {LINES} SELECT doc_id, line_no, md5(last_value(CASE WHEN len(string_split(trim(line, ' '), ' ')) <= 2 THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no)) AS section FROM lines",
    "islands_join": f"WITH {LINES}, i AS (SELECT *, sum(CASE WHEN len(string_split(trim(line, ' '), ' ')) <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines) SELECT doc_id, island::BIGINT AS island, md5(string_agg(line, ' ' ORDER BY line_no)) AS text FROM i GROUP BY 1, 2",
    "text_clean": f"""SELECT doc_id, md5({CLEAN}) AS clean, length(substr({CLEAN}, 1, 200)) AS cut,
md5(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\t\\r\\n]+', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS scrubbed, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS compact FROM documents""",
    "ngram_jaccard": f"SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM (SELECT p_partkey, {GRAMS.format('lower(p_name)')} AS a, {GRAMS.format('lower(p_type)')} AS b FROM part)",
    "sentence_counts": f"SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)",
    "token_statistics": f"SELECT doc_id, len({TOKENS}) AS tokens, len(list_distinct({TOKENS})) AS distinct_tokens FROM documents",
    "length_by_class": "SELECT quality, round(avg(length(text)), 4) AS length, round(avg(len(regexp_extract_all(text, '[0-9]'))), 4) AS digits, round(avg(len(regexp_extract_all(text, '[^A-Za-z0-9_]'))), 4) AS others FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "pattern_entities": r"""SELECT doc_id, kind, count(*) AS n, count(DISTINCT value) AS distinct_n FROM (
SELECT doc_id, 'number' AS kind, unnest(regexp_extract_all(lower(text), '\b[0-9]{3,}\b')) AS value FROM documents UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+')) FROM documents
UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(lower(text), 'https?://[^ \n]+')) FROM documents UNION ALL SELECT doc_id, 'address', unnest(regexp_extract_all(lower(text), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) FROM documents) GROUP BY 1, 2""",
    "url_normalise": r"SELECT page_id, CASE WHEN h <> '' THEN 'https://' || h || regexp_extract(u, '^https?://[^/]*(.*)$', 1) END AS url FROM (SELECT page_id, u, lower(regexp_extract(u, '^https?://([^/]*)', 1)) AS h FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS u FROM pages))",
    "html_links": r"""SELECT page_id, len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS links, md5(nullif(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), ' '), '')) AS title, regexp_matches(lower(html), '(no products found|no results|"products" *: *\[ *\])') AS is_empty FROM pages""",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "price_parse": "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part",
    "dirty_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders",
    "exact_duplicates": "SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "first_seen": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {CLEAN} ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "path_leaves": f"WITH p AS ({PREFIXES}) SELECT array_to_string(path, ' ') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE len(q.path) > len(p.path) AND q.path[1:len(p.path)] = p.path)",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "fuzzy_ratio", "recursive_split"]}

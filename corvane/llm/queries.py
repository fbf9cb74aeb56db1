"""The ten operators as registered queries, with production parameters, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontaminate, hilbert, hmm, htmltext, langid, leaderboard, neardup, packing, prefixtrie, quality, secrets, simhash
from .common import documents, fold

#: Names of public vocabularies; tasks find their paths.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(documents(spark, sf_dir), shingle=3, threshold=(85, 100))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    found = langid.identify(rows, model)
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.features(audio.kept(documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY, RANKS)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(*secrets.ledgered(documents(spark, sf_dir)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(documents(spark, sf_dir))


def op11_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sale_lines, vendors, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sale_lines", "vendors", "items"))
    return leaderboard.feed(leaderboard.lines(sale_lines, vendors, items))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(documents(spark, sf_dir), shingle=3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefixtrie.build(prefixtrie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return nodes.drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_media_columns": op4_media_columns,
    "op5_packing": op5_packing,
    "op6_secret_scans": op6_secret_scans,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_change_feed": op11_change_feed,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

#: A-Z in lower case, words of the text, distinct shingles, links by counted shared shingles, smallest id reachable.
NEAR_DEDUP_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def secret_sql() -> str:
    """Spans from the parts between matches and the matches, as the operator has them."""
    rules = {**secrets.BASE, **secrets.MORE}
    quoted = {k: p.replace("'", "''") for k, (p, *_) in rules.items()}
    scans = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k}' AS kind, {least} AS least, string_split_regex(text, '{quoted[k]}') AS parts, regexp_extract_all(text, '{quoted[k]}', 0) AS hits, regexp_extract_all(text, '{quoted[k]}', {group}) AS wide FROM t WHERE regexp_matches(text, '{quoted[k]}')"
        for i, (k, (_, group, least)) in enumerate(rules.items())
    )
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    line = "kind || ':' || start || ':' || (start + length(hit))"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({scans}),
i AS (SELECT doc_id, rank, kind, least, parts, hits, wide, unnest(range(1, len(hits) + 1)) AS i FROM m),
e AS (SELECT doc_id, rank, kind, hits[i] AS hit, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM i WHERE length(wide[i]) >= least),
g AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg({line}, ',' ORDER BY start, rank) AS spans FROM e GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, byte by byte over a table made from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        table.append(f"{n}::UBIGINT")
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    step = f"xor(list_extract([{', '.join(table)}], (xor(c, x) & 255)::BIGINT + 1), c >> 8)"
    return f"xor(list_reduce({of_bytes}, lambda c, x: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"


def shard_sql(shards: int = 8, bits: int = 5) -> str:
    """Cells of size, language and source, their place on the Hilbert curve, equal runs of the order."""
    steps: list[str] = []
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        p = q - 1
        for i in "abc":
            other = f"xor({i}, xor(a, {i}) & {p})" if i != "a" else "a"
            mine = f", CASE WHEN {i} & {q} <> 0 THEN {i} ELSE {other} END AS {i}" if i != "a" else ""
            swapped = f"xor(a, xor(a, {i}) & {p})" if i != "a" else "a"
            steps.append(f"CASE WHEN {i} & {q} <> 0 THEN xor(a, {p}) ELSE {swapped} END AS a{mine}")
    steps += ["xor(b, a) AS b", "xor(c, b) AS c"]
    t = "0"
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        t = f"xor({t}, CASE WHEN c & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    steps.append(", ".join(f"xor({i}, {t}) AS {i}" for i in "abc"))
    chain = ", ".join(f"s{n + 1} AS (SELECT * REPLACE ({step}) FROM s{n})" for n, step in enumerate(steps))
    curve = " + ".join(f"(({i} >> {b}) & 1) * {1 << (3 * b + 2 - k)}" for b in range(bits) for k, i in enumerate("abc"))
    top = (1 << bits) - 1
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS mark, lang, source FROM documents),
g AS (SELECT mark, min(lang) AS lang, min(source) AS source FROM t GROUP BY 1),
n AS (SELECT doc_id, text, size, mark, coalesce(g.lang, t.lang, '?') AS lang, coalesce(g.source, t.source, '?') AS source FROM t JOIN g USING (mark)),
l AS (SELECT x, {crc_sql("x")} % {1 << bits} AS cell FROM (SELECT lang AS x FROM n UNION SELECT source FROM n)),
s0 AS (SELECT n.*, {crc_sql("text")} AS crc, greatest(0, least(2 * (length(bin(size)) - 1) + CASE WHEN substr(bin(size), 2, 1) = '1' THEN 1 ELSE 0 END - 8, {top}))::BIGINT AS a, p.cell AS b, q.cell AS c FROM n JOIN l p ON p.x = lang JOIN l q ON q.x = source),
{chain},
o AS (SELECT *, {curve} AS curve FROM s{len(steps)}),
r AS (SELECT *, row_number() OVER (ORDER BY curve, crc, mark, doc_id) - 1 AS place, count(*) OVER () AS total FROM o),
d AS (SELECT *, (((place + 1) * {shards} - 1) // total)::INT AS shard FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard, place - (shard * total) // {shards} AS slot, NULL::INT AS grown_shard, curve FROM d"""


def feed_sql() -> str:
    """Running revenues and their rank on every arrival day of a nation, against the day before."""
    return f"""WITH x AS (SELECT l.*, {crc_sql("concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(l.item_id::VARCHAR, ''), ',', coalesce(l.vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, ''))")} AS h FROM sale_lines l),
d AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150) AS s FROM x),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM d),
b AS (SELECT *, least(10, greatest(1, 1 + floor((a - 19723) * 10 / 180)))::INT AS batch FROM a),
m AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM b GROUP BY batch),
v AS (SELECT vendor_id, min(nation_id) AS nation FROM vendors GROUP BY 1), i AS (SELECT item_id, min(price) AS price FROM items GROUP BY 1),
r AS (SELECT nation, b.item_id AS item, a, batch, sum(CASE WHEN flag = 'swapped' THEN -1.0 ELSE 1.0 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0.0)) AS cents
  FROM b JOIN m USING (batch) JOIN v USING (vendor_id) JOIN i ON i.item_id = b.item_id WHERE nation IS NOT NULL AND (late IS NULL OR s + 3 >= late) GROUP BY ALL),
c AS (SELECT nation, item, a, sum(cents) OVER (PARTITION BY nation, item ORDER BY a) AS revenue, lead(a) OVER (PARTITION BY nation, item ORDER BY a) AS until FROM r),
n AS (SELECT nation, a, min(batch) AS batch, row_number() OVER (PARTITION BY nation ORDER BY a) AS step FROM r GROUP BY nation, a),
k AS (SELECT n.nation, n.step, c.item, c.revenue, row_number() OVER (PARTITION BY n.nation, n.step ORDER BY c.revenue DESC, c.item) AS place FROM n JOIN c ON c.nation = n.nation AND c.a <= n.a AND (c.until IS NULL OR c.until > n.a) WHERE c.revenue > 0 QUALIFY place <= 10),
e AS (SELECT coalesce(o.nation, p.nation) AS nation, coalesce(o.item, p.item) AS item, coalesce(o.step, p.step + 1) AS step, p.place AS old_rank, o.place AS new_rank FROM k o FULL JOIN k p ON p.nation = o.nation AND p.item = o.item AND p.step = o.step - 1 WHERE o.place IS DISTINCT FROM p.place)
SELECT e.nation AS nation_id, n.a AS arrival_day, e.item AS item_id, n.batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank::INT AS old_rank, new_rank::INT AS new_rank, c.revenue::BIGINT AS revenue
FROM e JOIN n ON n.nation = e.nation AND n.step = e.step JOIN c ON c.nation = e.nation AND c.item = e.item AND c.a <= n.a AND (c.until IS NULL OR c.until > n.a)"""


def trie_sql() -> str:
    """Rebuilt conversations, every first part of each, and sums over all nodes below each."""
    mark = "md5(length(role) || ':' || role || text)"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, {mark} AS mark, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {mark}) AS place FROM t),
o AS (SELECT conv_id, list(mark ORDER BY place) AS marks, list(words ORDER BY place) AS words, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM p GROUP BY 1),
r AS (SELECT o.conv_id, list_concat(coalesce(b.marks, [])[1:o.h], o.marks[o.h + 1:]) AS marks, list_concat(coalesce(b.words, [])[1:o.h], o.words[o.h + 1:]) AS words FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
d AS (SELECT *, unnest(range(len(marks) + 1)) AS depth FROM r),
k AS (SELECT conv_id, depth, md5(array_to_string(marks[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(marks[1:depth - 1], ',')) END AS above, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words, len(marks) = depth AS ends FROM d),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM k GROUP BY ALL),
c AS (SELECT above, count(*) AS n_children FROM n GROUP BY 1),
s AS (SELECT k.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (c.above IS NULL) AS n_leaves FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth LEFT JOIN c ON c.above = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN n u ON u.node = n.above LEFT JOIN c ON c.above = n.node"""


ORACLE_SQL: dict[str, str] = {"op2_near_dedup": NEAR_DEDUP_SQL, "op6_secret_scans": secret_sql(), "op10_sharding": shard_sql(), "op11_change_feed": feed_sql(), "op13_prefix_trie": trie_sql()}

"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger holds (blob, rules) for each blob
already scanned under a version of the rules, and its findings. A run takes the blobs of all given
rows, leaves out those of the ledger, scans the rest once each however many rows hold them, appends
both tables, and joins findings back to all rows (paths). A changed rule set has another version and
scans everything again. Findings are appended first; a run that dies before its blobs are marked as seen
scans them again, and of a blob's findings under one version a reader takes one row.

Spans come from two consistent passes of one pattern, split and extract: running sums of the lengths of the parts
between matches and of the matches give code-point offsets. ``assign``, ``access`` and ``hex`` are the
base rules; the further rules only add spans.

Null and empty texts have no findings. Repeated rows are joined each. An empty table gives none.
Overlapping spans of different kinds all stay. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, free

#: Kind -> (pattern, group that must have a least length, that length), in listed order.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Further kinds of public token formats.
MORE = {
    "bearer": (r"(?i)bearer\x20+[A-Za-z0-9._~+/=-]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
}
#: A pattern of the same matches as the rule once short ones are dropped, for kinds whose matches are maximal runs.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
RULES_VERSION = "1"
#: Blobs that may be sent to every task: about 10 MB.
SENT = 100_000

SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"
#: Code points of a block of a text; a place in a text is found within its block.
BLOCK = 1024


def hits(text: Column, kind: str, rules: dict) -> Column:
    """Matches of one kind in order: array<struct<before, long, wide>>, the lengths of what lies before each, of it, and of the part with a least length."""
    pattern, group, _ = rules[kind]
    pattern = QUICK.get(kind, pattern)
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wide = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.transform(F.arrays_zip(parts.alias("p"), found.alias("h"), wide.alias("w")), lambda x: F.struct(F.length(x["p"]).alias("before"), F.length(x["h"]).alias("long"), F.length(x["w"]).alias("wide")))
    return F.when(text.rlike(pattern), lengths)


def scan(blobs: DataFrame, text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """blob, base, spans (both by start, then rank) of the blobs with any span; ``blobs`` has each blob once.

    Starts are running sums over a blob's matches, so the work grows with the matches of a text and not with their square. The sums and the
    arrays need no shuffle where ``blobs`` lie by blob.
    """
    rules = {**BASE, **MORE} if rules is None else rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.lit(rules[k][2]).alias("least"), hits(text, k, rules).alias("hits")) for i, k in enumerate(rules)]
    kinds = blobs.select("blob", F.explode(F.filter(F.array(*each), lambda x: x["hits"].isNotNull())).alias("x"))
    listed = kinds.select("blob", "x.rank", "x.kind", "x.least", F.posexplode("x.hits").alias("place", "hit")).where("hit.long is not null")
    upto = Window.partitionBy("blob", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = listed.withColumn("end", F.sum(F.col("hit.before") + F.col("hit.long")).over(upto).cast("int")).where("hit.wide >= least")
    span = F.struct((F.col("end") - F.col("hit.long")).alias("start"), "rank", "kind", "end")
    gathered = ends.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))
    return gathered.select("blob", F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("base"), "spans")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ledgered(docs: DataFrame, ledger: str | None = None, version: str = RULES_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths: _id, blob; findings: blob, base, spans of every blob with any), after the scan of unseen blobs.

    ledger: folder of earlier runs' tables ``seen`` and ``findings``; new parts are appended there.
    None: a new one in the shared folder, which goes when the program ends.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "ledger")
    ledger = ledger or space.path
    text = F.coalesce(docs[text_col], F.lit(""))
    paths = space.save(docs.select(docs[id_col].alias("_id"), F.sha2(text, 256).alias("blob")), "paths")
    blobs = paths.select("blob").distinct()
    try:
        seen = spark.read.parquet(f"{ledger}/seen")
    except Exception as error:  # a new ledger has no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        seen = None
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    new = space.save(blobs, "new")
    # one text of each unseen blob; copies go before the shuffle, and so do seen blobs where the new ones are few
    source = docs.select(text.alias("_text")).where(F.col("_text") != "").withColumn("blob", F.sha2("_text", 256))
    few = new.count() <= SENT
    if few:
        source = source.join(F.broadcast(new), "blob", "left_semi")
    once = source.groupBy("blob").agg(F.first("_text").alias("_text"))
    if not few:
        once = once.join(new, "blob", "left_semi")
    findings = scan(once, "_text").withColumn("version", F.lit(version))
    findings.write.mode("append").parquet(f"{ledger}/findings")
    new.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{ledger}/seen")
    return paths, spark.read.schema(findings.schema).parquet(f"{ledger}/findings").where(F.col("version") == version).drop("version").dropDuplicates(["blob"])


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digests(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every path."""
    none = F.array().cast(SPAN)
    rows = paths.join(findings, "blob", "left").select(F.col("_id").alias("doc_id"), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("every"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def merged(findings: DataFrame) -> DataFrame:
    """blob, parts: spans by start, those that overlap as one: array<struct<start, end>>."""
    by_start = Window.partitionBy("blob").orderBy("start", "rank")
    spans = findings.select("blob", F.inline("spans"))
    fresh = F.coalesce(F.col("start") >= F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = spans.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("blob", "part").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"))
    return parts.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("parts"))


def pieces(text: Column, parts: Column) -> Column:
    """What a text has before, between and after the parts. Each piece is taken from the blocks that hold it, so none is sought from the text's start."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cuts = F.transform(parts, lambda s, i: F.struct(F.coalesce(F.get(parts, i - 1)["end"], F.lit(0)).alias("a"), s["start"].alias("b")))
    cuts = F.concat(cuts, F.array(F.struct(F.element_at(parts, -1)["end"].alias("a"), F.length(text).alias("b"))))
    first = lambda c: F.floor(c["a"] / BLOCK).cast("int")
    held = lambda c, x: F.array_join(F.slice(x, first(c) + 1, F.floor(c["b"] / BLOCK).cast("int") - first(c) + 1), "")
    one = F.transform(F.array(F.struct(blocks.alias("x"), cuts.alias("cuts"))), lambda t: F.transform(t["cuts"], lambda c: F.substring(held(c, t["x"]), c["a"] % BLOCK + 1, c["b"] - c["a"])))
    return one[0]


def redact(docs: DataFrame, paths: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span's text replaced by ``mark``; overlapping spans become one."""
    path, own, blob, spans_ = free(docs.columns, "_path", "_found", "_blob", "_spans")
    found = paths.join(merged(findings), "blob").select(F.col("_id").alias(path), F.col("blob").alias(own), F.col("parts").alias(spans_))
    per_path = found.groupBy(path, own).agg(F.first(spans_).alias(spans_))
    rows = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    both = rows.join(per_path, F.col(id_col).eqNullSafe(F.col(path)) & (F.col(blob) == F.col(own)), "left")
    text = F.col(text_col)
    clean = F.array_join(pieces(text, F.col(spans_)), mark)
    return both.select(*[F.when(F.col(spans_).isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])

"""Facts from texts: acceptance with reasons, evidence, review, incremental work, hierarchies, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import first_reason, within_hops


def squeezed(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def grounded(names: list[Column], text: Column) -> Column:
    """Whether a text holds all names, whatever their white space; an empty name isn't held."""
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce((squeezed(name) != "") & F.contains(squeezed(text), squeezed(name)), F.lit(False))
    return out


def accepted(facts: DataFrame, pages: DataFrame, schema: DataFrame, relations: list[str]) -> DataFrame:
    """``facts`` with reason: accepted, or the first of: unknown relation, wrong types, ungrounded, duplicate.

    facts: fact_id, subject, subject_type, relation, object, object_type, evidence, page; pages: page,
    text; schema: subject_type, relation, object_type, a small list that is counted before it is sent.
    """
    from .ranking import sent

    allowed = sent(schema.select("subject_type", "relation", "object_type", F.lit(True).alias("_typed")).distinct())
    texts = pages.select("page", F.col("text").alias("_text"))
    joined = facts.join(allowed, ["subject_type", "relation", "object_type"], "left").join(texts, "page", "left")
    evident = grounded([F.col("evidence")], F.col("_text")) & grounded([F.col("subject"), F.col("object")], F.col("evidence"))
    checked = joined.withColumn("_bad", first_reason([("unknown relation", ~F.col("relation").isin(relations)), ("wrong types", F.col("_typed").isNull()), ("ungrounded", ~evident)], "accepted"))
    ranked = checked.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("subject"), "relation", F.lower("object"), "_bad").orderBy("fact_id")))
    return ranked.withColumn("reason", F.when((F.col("_bad") == "accepted") & (F.col("_n") > 1), "duplicate").otherwise(F.col("_bad"))).select(*facts.columns, "reason")


def reviewed(facts: DataFrame, excluded: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Facts without the excluded ones, and the added ones, each with its origin."""
    kept = facts.join(excluded.select(key), key, "left_anti").withColumn("origin", F.lit("extracted"))
    return kept.unionByName(added.withColumn("origin", F.lit("review")))


def replaced_source(table: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of the sources of ``new`` give way to its rows."""
    return table.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def pending(rows: DataFrame, done: DataFrame, key: str, content: Column, version: str) -> DataFrame:
    """Rows that no finished row of the same key, content hash and version stands for. done: key, sha, version."""
    hashed = rows.withColumn("sha", F.sha2(content, 256))
    return hashed.join(done.where(F.col("version") == version).select(key, "sha"), [key, "sha"], "left_anti")


def neighbour_repair(rows: DataFrame, lines: DataFrame, key: str, page: str, at: str, evidence: str, reach: int = 2) -> DataFrame:
    """Adds found_at: the line that holds the evidence: the named one, or the only one within ``reach`` lines."""
    near = rows.select(key, page, F.col(at).alias("_at"), evidence, F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias("line_no"))
    met = near.join(lines.select(page, "line_no", "line"), [page, "line_no"]).where(F.contains(squeezed(F.col("line")), squeezed(F.col(evidence))))
    per = met.groupBy(key).agg(F.max(F.when(F.col("line_no") == F.col("_at"), F.col("line_no"))).alias("_own"), F.count("*").alias("_n"), F.min("line_no").alias("_one"))
    found = per.select(key, F.coalesce("_own", F.when(F.col("_n") == 1, F.col("_one"))).alias("found_at"))
    return rows.join(found, key, "left")


def ancestors(hierarchy: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, steps): all ancestors of each node up to a depth, itself at 0, least steps."""
    base = hierarchy.select(F.col("node").alias("src"), F.col("parent").alias("dst")).where("dst is not null")
    nodes = hierarchy.select("node").unionAll(hierarchy.select("parent")).where("node is not null").select(F.col("node").alias("seed")).distinct()
    return within_hops(base, nodes, depth, directed=True).select(F.col("seed").alias("node"), F.col("node").alias("ancestor"), F.col("hops").alias("steps"))


def path_similarity(hierarchy: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """a, b, similarity, meets: 1 / (1 + the shortest way over a common ancestor), and the nearest such one."""
    up = ancestors(hierarchy, depth)
    x = up.select(F.col("node").alias("a"), "ancestor", F.col("steps").alias("_x"))
    y = up.select(F.col("node").alias("b"), "ancestor", F.col("steps").alias("_y"))
    met = pairs.join(x, "a").join(y, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.struct((F.col("_x") + F.col("_y")).alias("way"), "ancestor")).alias("m"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce(F.round(1 / (1 + F.col("m.way")), 6), F.lit(0.0)).alias("similarity"), F.col("m.ancestor").alias("meets"))


def reranked(ranked: DataFrame, score: Callable[[Column, Column], Column], group: list[str], query: str, text: str, rank: str, pool: int, k: int) -> DataFrame:
    """The first ``pool`` rows by a scorer's value, others left out; rows without a finite score keep their fused order after those with one."""
    scored = ranked.where(F.col(rank) <= pool).withColumn("rerank_score", score(F.col(query), F.col(text)))
    finite = F.when(~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf")), F.col("rerank_score"))
    order = Window.partitionBy(*group).orderBy(finite.desc_nulls_last(), F.col(rank))
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def bipartite_matches(candidates: DataFrame, reviewed_rows: DataFrame, keys: list[str], canonical: dict[str, str], name: str) -> DataFrame:
    """Reviewed rows with found: whether a candidate of the same keys and canonical name is there, and how many."""
    table = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv]) if canonical else F.create_map().cast("map<string,string>")
    key = lambda c: F.coalesce(F.try_element_at(table, F.lower(c)), F.lower(c))
    have = candidates.select(*keys, key(F.col(name)).alias("_c")).groupBy(*keys, "_c").agg(F.count("*").alias("candidates"))
    out = reviewed_rows.withColumn("_c", key(F.col(name))).join(have, [*keys, "_c"], "left").drop("_c")
    return out.withColumn("found", F.col("candidates").isNotNull()).withColumn("candidates", F.coalesce("candidates", F.lit(0)))

"""Property graphs as node and edge tables: upserts, checks, patterns, bounded hops, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Tables


def latest(df: DataFrame, key: list[str], version: list[Column], order: Column) -> DataFrame:
    """The newest version of each key; of equal versions the first in ``order``."""
    over = Window.partitionBy(*key).orderBy(*[v.desc_nulls_last() for v in version], order.asc())
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key: a new value that isn't null wins."""
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])


def retained_edges(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select(F.col(node).alias("_node")).distinct()
    return edges.join(ids, edges[source] == ids["_node"], "left_semi").join(ids, F.col(target) == ids["_node"], "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame, node: str, end: str) -> DataFrame:
    """Edges whose ``end`` isn't a node."""
    ids = nodes.select(F.col(node).alias("_node"))
    return edges.join(ids, edges[end] == ids["_node"], "left_anti")


def crossing(edges: DataFrame, nodes: DataFrame, node: str, group: str, source: str, target: str) -> DataFrame:
    """Edges whose ends are of different groups, with both groups: from_group, to_group. Ends without a group or a node cross nothing."""
    own = nodes.where(F.col(group).isNotNull()).select(F.col(node).alias("_n"), F.col(group).alias("_g"))
    out = edges.join(own.select(F.col("_n").alias(source), F.col("_g").alias("from_group")), source).join(own.select(F.col("_n").alias(target), F.col("_g").alias("to_group")), target)
    return out.where("from_group != to_group").select(*edges.columns, "from_group", "to_group")


def isolated(nodes: DataFrame, edges: DataFrame, node: str, ends: list[str]) -> DataFrame:
    """Nodes at neither end of any edge."""
    touched = reduce(DataFrame.unionAll, [edges.select(F.col(e).alias("_end")) for e in ends])
    return nodes.join(touched, nodes[node] == touched["_end"], "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(seed, node, hops): nodes reached from each seed by at most ``hops`` edges in any direction, at the least count.

    edges: src, dst; seeds: seed. The frontier of each turn is what no earlier turn has reached; it is written in the
    shared folder, so a turn's plan holds that turn alone. It ends early when nothing new is reached.
    """
    space = Tables(edges.sparkSession, "hops")
    both = space.save(edges.select("src", "dst").distinct() if directed else undirected(edges), "edges")
    start = seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("hops", F.lit(0))
    frontier = reached = space.save(start, "0")
    for hop in range(1, hops + 1):
        ahead = frontier.join(both, frontier["node"] == both["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = space.save(ahead.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)), str(hop))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def paths(edges: DataFrame, seeds: DataFrame, low: int, high: int, limit: int, direction: str = "both", end: Column | None = None, rel: str = "id") -> DataFrame:
    """The first ``limit`` paths of each ask: ask, seed, node (its end), hops, nodes, rels, place, truncated.

    edges: the relationship's id, src, dst; seeds: ask, seed. A path has ``low`` to ``high`` relationships, none of them twice
    (nodes may be), followed forwards (out), backwards (in) or either way (both). Paths are ordered by their list of relationship
    ids, then by seed and nodes; a list comes before those that it begins. truncated: whether the ask has more than ``limit``. end: a condition on
    the path's end, ``node``. Seeds that repeat count once; null ends and ids make no step.

    Each turn extends the last turn's frontier and writes it. Without a condition every path of ``low`` steps or more counts, and those that
    begin with it come right after it: what isn't among the first limit + 1 of its length can be left out with all that follows from it, so
    a frontier holds limit + 1 paths an ask however many there are. With ``end`` all paths up to ``high`` steps are followed.
    """
    space = Tables(edges.sparkSession, "paths")
    known = edges.where(f"{rel} is not null and src is not null and dst is not null")
    out = known.select(F.col(rel).alias("_rel"), F.col("src").alias("_from"), F.col("dst").alias("_to"))
    back = known.where("src != dst" if direction == "both" else "true").select(F.col(rel).alias("_rel"), F.col("dst").alias("_from"), F.col("src").alias("_to"))
    steps = space.save({"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct(), "steps")
    empty = F.array().cast(f"array<{dict(steps.dtypes)['_rel']}>")
    own = seeds.select("ask", "seed").distinct()
    frontier = space.save(own.select("ask", "seed", F.col("seed").alias("node"), F.array("seed").alias("nodes"), empty.alias("rels")), "0")
    order = Window.partitionBy("ask").orderBy("rels", "seed", "nodes")
    found = [frontier] if low == 0 else []
    for hop in range(1, high + 1):
        ahead = frontier.join(steps, frontier["node"] == steps["_from"]).where(~F.array_contains("rels", F.col("_rel")))
        ahead = ahead.select("ask", "seed", F.col("_to").alias("node"), F.concat("nodes", F.array("_to")).alias("nodes"), F.concat("rels", F.array("_rel")).alias("rels"))
        if end is None and hop >= low:
            ahead = ahead.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit + 1).drop("_n")
        frontier = space.save(ahead, str(hop))
        if hop >= low:
            found.append(frontier)
    every = reduce(DataFrame.unionAll, found)
    placed = (every if end is None else every.where(end)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)
    marked = placed.withColumn("truncated", F.max("place").over(Window.partitionBy("ask")) > limit)
    return marked.where(F.col("place") <= limit).select("ask", "seed", "node", F.size("rels").alias("hops"), "nodes", "rels", "place", "truncated")


def components(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the least node of each undirected component.

    Alternating large-star and small-star steps; each is written in the shared folder, so lineage stays
    short and a lost executor loses nothing. Only a count and a checksum reach the driver.
    """
    space, turn, seen = Tables(edges.sparkSession, "components"), 0, None
    links = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a != b").distinct()
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionAll(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a != b")
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        links = space.save(small, str(turn))
        if turn:
            space.drop(str(turn - 1))
        turn += 1
        now = tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen or now[0] == 0:
            break
        seen = now
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select(F.col(node).alias("node")).distinct().join(roots, F.col("node") == roots["a"], "left").select("node", F.coalesce("root", "node").alias("component"))


def resolved(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(node, component): records that share any key value, transitively. Null and empty keys link nothing.

    Records and key values are the two sides of a graph: each record is linked to the least record of
    each of its key values, never to all of them.
    """
    parts = [records.select(F.col(record).alias("r"), F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys]
    listed = reduce(DataFrame.unionAll, parts).where("value is not null and value != ''")
    first = listed.groupBy("kind", "value").agg(F.min("r").alias("src"), F.count("*").alias("n")).where("n > 1")
    edges = listed.join(first, ["kind", "value"]).where("r != src").select("src", F.col("r").alias("dst")).distinct()
    return components(edges, records.select(F.col(record).alias("node")))


def filled(df: DataFrame, group: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per group: of each field the first value, in order, that isn't null or empty."""
    rank = F.struct(*order)
    value = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
    return df.groupBy(*group).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), rank)).alias(c) for c in fields])


def cooccurrence(mentions: DataFrame, group: str, order: list[str], value: str, ahead: int = 2) -> DataFrame:
    """(group, source, target, distance): each mention with the next ``ahead`` different ones."""
    over = Window.partitionBy(group).orderBy(*order)
    parts = [mentions.select(group, F.col(value).alias("source"), F.lead(value, d).over(over).alias("target"), F.lit(d).alias("distance")) for d in range(1, ahead + 1)]
    return reduce(DataFrame.unionAll, parts).where("target is not null and source != target")


def bio_spans(tokens: DataFrame, key: str, order: str, word: str, tag: str) -> DataFrame:
    """Entity spans of BIO tags: key, label, begin, text. An I tag without a B of its label before it begins none."""
    over = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(F.col(tag).startswith("B-") | (F.col(tag) == "O"), 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0))
    grouped = tokens.withColumn("_i", island).groupBy(key, "_i").agg(F.sort_array(F.collect_list(F.struct(order, word, tag))).alias("_t"))
    head = F.col("_t")[0]
    own = F.filter("_t", lambda t: F.substring(t[tag], 3, 100) == F.substring(head[tag], 3, 100))
    return grouped.where(head[tag].startswith("B-")).select(key, F.substring(head[tag], 3, 100).alias("label"), head[order].alias("begin"), F.array_join(F.transform(own, lambda t: t[word]), " ").alias("text"))


def leaves(paths: DataFrame, path: str) -> DataFrame:
    """Paths (arrays) that no other path has as a proper prefix."""
    parents = paths.select(F.explode(F.expr(f"transform(sequence(1, greatest(size({path}) - 1, 1)), i -> slice({path}, 1, i))")).alias("_parent"), F.size(path).alias("_n")).where("_n > size(_parent)").select("_parent").distinct()
    return paths.join(parents, paths[path] == parents["_parent"], "left_anti")


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first rule that holds."""
    out = F
    for name, rule in rules:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(otherwise))

"""Graph jobs: snapshot claims, reviewed graphs, fact expansion, promotion, links of chunks, scripts and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary, graph


def claims(stored: DataFrame, new: DataFrame, key: str, dataset: str) -> DataFrame:
    """One row: datasets in the store, rows that are new, same, and in conflict, and whether the claim may go on.

    A claim may go on only where the store holds no other dataset and no row of the same key differs.
    """
    columns = [c for c in new.columns if c not in (key, dataset)]
    old = stored.select(F.col(key), F.col(dataset).alias("_set"), F.struct(*columns).alias("_old"))
    both = new.join(old, key, "left")
    differs = ~F.col("_old").eqNullSafe(F.struct(*columns))
    counted = both.agg(
        F.count_if(F.col("_old").isNull()).alias("added"),
        F.count_if(F.col("_old").isNotNull() & ~differs).alias("same"),
        F.count_if(F.col("_old").isNotNull() & differs).alias("conflicts"),
    )
    others = stored.select(F.col(dataset).alias("_d")).distinct().join(new.select(F.col(dataset).alias("_d")).distinct(), "_d", "left_anti").agg(F.count("*").alias("foreign"))
    return counted.crossJoin(F.broadcast(others)).withColumn("allowed", (F.col("foreign") == 0) & (F.col("conflicts") == 0))  # one row each


def expanded_facts(rows: DataFrame, key: str, relations: dict[str, str]) -> DataFrame:
    """(key, relation, object): one row of each column that isn't null, arrays one of each element."""
    kinds = dict(rows.dtypes)

    def each(column: str, relation: str) -> Column:
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column).cast("string"))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(relation).alias("relation"), x.alias("object")))

    return rows.select(key, F.explode(F.concat(*[each(c, r) for c, r in relations.items()])).alias("f")).select(key, "f.*").where("object is not null and object != ''")


def reviewed_graph(cases: DataFrame, items: DataFrame, case: str, item: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, evidence) and edges (source, target) of reviewed cases that name known items; evidence merged by key."""
    edges = cases.join(items.select(item).distinct(), item, "left_semi").select(F.concat(F.lit("case:"), F.col(case).cast("string")).alias("source"), F.concat(F.lit("item:"), F.col(item).cast("string")).alias("target"), evidence)
    ends = edges.select(F.col("source").alias("id"), F.lit("case").alias("kind"), evidence).unionAll(edges.select(F.col("target").alias("id"), F.lit("item").alias("kind"), evidence))
    nodes = ends.groupBy("id", "kind").agg(F.array_sort(F.collect_set(evidence)).alias(evidence))
    return nodes, edges.select("source", "target").distinct()


def promoted(nodes: DataFrame, edges: DataFrame, approved: Column, seeds: DataFrame, hops: int) -> DataFrame:
    """Approved nodes with the least hops from any seed over edges between approved nodes; null where none is reached."""
    kept = nodes.where(approved)
    own = graph.retained_edges(edges, kept, "id", "src", "dst")
    reached = graph.within_hops(own, seeds, hops).groupBy("node").agg(F.min("hops").alias("hops"))
    return kept.join(reached, kept["id"] == reached["node"], "left").drop("node")


def chunk_links(chunks: DataFrame, entities: DataFrame, chunk: str, name: str) -> DataFrame:
    """(chunk, entity): entities whose name a chunk's words hold, in order and next to each other; found in one pass over each text."""
    worded = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    names = entities.select(F.col(name).alias("entity"), worded(F.col(name)).alias("_n")).where("_n != '  '").distinct()
    met = dictionary.found(chunks.select(chunk, worded(F.col("text")).alias("_t")), names, chunk, "_t", "_n", dictionary.anywhere)
    return met.join(names, F.col("term") == F.col("_n")).select(chunk, "entity").distinct()


def literal(value: Column) -> Column:
    """A quoted literal of a graph script; null as null."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.coalesce(quoted, F.lit("null"))


def script(nodes: DataFrame, label: str, key: str, properties: list[str]) -> DataFrame:
    """statement: one keyed merge of each node."""
    sets = F.concat_ws(", ", *[F.concat(F.lit(f"n.{p} = "), literal(F.col(p))) for p in properties])
    return nodes.select(F.concat(F.lit(f"MERGE (n:{label} {{{key}: "), literal(F.col(key)), F.lit("}) SET "), sets, F.lit(";")).alias("statement"))


def question_sections(texts: DataFrame, text: str) -> DataFrame:
    """Question and answer of each "## question" section of Markdown texts, with its number."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), "\n## "), lambda p, i: i > 0)
    listed = texts.select(*[c for c in texts.columns if c != text], F.posexplode(parts).alias("n", "_p"))
    head = F.substring_index("_p", "\n", 1)
    return listed.withColumn("question", F.trim(head)).withColumn("answer", F.trim(F.substr("_p", F.length(head) + 2), F.lit(" \n"))).drop("_p")


def branches(lines: DataFrame, line: str, order: str, group: str) -> DataFrame:
    """Branch lines "- name: address" under province lines "# province": group, province, name, address, first of each name."""
    from pyspark.sql import Window

    over = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.nullif(F.regexp_extract(line, "^# *(?:province of |จังหวัด)?(.*?) *$", 1), F.lit(""))
    placed = lines.withColumn("province", F.last(F.when(F.col(line).startswith("#"), named), True).over(over)).where(F.col(line).startswith("- "))
    found = placed.select(group, order, "province", F.trim(F.regexp_extract(line, "^- ([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(line, "^- [^:]*:(.*)$", 1)).alias("address"))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(group, "province", F.lower("name")).orderBy(order))).where("_n = 1 and name != ''")
    return first.drop("_n", order)


def projected(objects: DataFrame, key: str, refs: str, wanted: str, names: list[str]) -> DataFrame:
    """key, ref (the first external reference of the wanted source), aliases (both lists, distinct and sorted)."""
    own = F.filter(refs, lambda r: r["source"] == wanted)
    return objects.select(key, F.try_element_at(own, F.lit(1))["id"].alias("ref"), F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(n), F.array().cast("array<string>")) for n in names]))).alias("aliases"))

"""Prefix trie of conversations, built as a Patricia tree.

A node is a distinct sequence of first turns (role and text), the root the empty one. A node's name is a digest chained over its
turns, so equal sequences have equal names, and a conversation is the array of the names along its path.

1. Sort: equal conversations are one class; the classes are dealt out by ranges of their paths and sorted. Neighbours are
   compared within each task; the two rows at either side of a range's border are compared afterwards (two rows of each task).
2. Points: only the ends of classes (leaves among them), the branches (the common prefix of two neighbours) and the root are
   made, each with the compressed edge above it. The first class in order that runs through an edge owns it. The part of a
   path that no neighbour shares has no point but its end, so it is never taken apart here.
3. Aggregates: every class adds to the points on its path: members, smallest member, leaves, children that it is first to
   run through, and turn words. The sum over a subtree of (members - 1) * words is the words of all members' turns less those
   of each node once, that is of the edges that the classes in it own. So one grouped sum gives all of them.
4. Expansion: an edge's unary nodes have its lower point's members, leaves and smallest member and one child; their sums
   over the subtree are the point's plus a suffix sum along the edge.

Null roles and texts count as empty. Turns are ordered by number, null first, then by digest, so ties are the same each time.
Turns without a conversation id belong to none and make no node. Repeated turns are turns. An empty table gives no row.
A conversation's path (16 bytes and a word count for each turn) is one value; its texts aren't brought together. The ids that
end at one node are put in order and digested by one task as they stream, as a digest of them in order demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

#: Conversations to a family that shares its first one's opening turns.
FAMILY = 20
#: One more than the most turns that are taken over.
OPENINGS = 4


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, mark, words) of each turn: its place from 1, a digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", mark.alias("mark"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return rows.select("conv", F.row_number().over(order).alias("place"), "mark", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, marks, words): the first h turns of the family's first conversation, then its own after its first h; h is crc32 of the id modulo OPENINGS."""
    own = turns(conversations).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "mark", "words"))).alias("own"))
    first = own.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("head"), F.slice("own", 1, OPENINGS - 1).alias("opening"))
    h = (F.crc32(F.col("conv").cast("string")) % OPENINGS).cast("int")
    both = own.withColumn("head", F.col("conv") - F.col("conv") % FAMILY).join(first, "head", "left").withColumn("h", h)
    opening = F.slice(F.coalesce("opening", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    path = F.concat(opening, F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv", path.alias("path")).select("conv", F.col("path.mark").alias("marks"), F.col("path.words").alias("words"))


def plain(conversations: DataFrame) -> DataFrame:
    """(conv, marks, words) of conversations as they are."""
    own = turns(conversations).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "mark", "words"))).alias("own"))
    return own.select("conv", F.col("own.mark").alias("marks"), F.col("own.words").alias("words"))


def chained(marks: list[bytes]) -> list[bytes]:
    """The names of the nodes along a path: each the digest of the name above and the turn."""
    out, name = [], b""
    for mark in marks:
        name = hashlib.md5(name + mark).digest()
        out.append(name)
    return out


def common(a: list | None, b: list | None) -> int:
    """Turns that two paths share; -1 where there is no neighbour. Names differ from the first difference on, so it is found by halving."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


NAMED = "conv long, path array<binary>, total array<bigint>"
COMMON = T.IntegerType()


def namer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names along each path, and the words of its turns up to each."""
    for batch in batches:
        paths = pa.array([chained(x) for x in batch.column(1).to_pylist()], pa.list_(pa.binary()))
        totals = pa.array([list(accumulate(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), paths, totals], ["conv", "path", "total"])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted classes (path first) with the turns that each shares with the row before and the row after it in this task, and the task's number.

    A row whose neighbour is in another task, or that has none, gets null. One row is held back from batch to batch.
    """
    task = TaskContext.get().partitionId()
    held, above = None, None

    def given(row: pa.RecordBatch, before: list, after: list) -> pa.RecordBatch:
        extra = [pa.array(x, pa.int32()) for x in (before, after, [task] * len(before))]
        return pa.RecordBatch.from_arrays([*row.columns, *extra], [*row.schema.names, "before", "after", "task"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
        paths = rows.column(0).to_pylist()
        shared = [common(a, b) for a, b in zip(paths, paths[1:])]
        if shared:
            yield given(rows.slice(0, len(shared)), [above, *shared[:-1]], shared)
            above = shared[-1]
        held = rows.slice(len(shared))
    if held is not None:
        yield given(held, [above], [None])


def bordered(space: Workspace, classes: DataFrame) -> DataFrame:
    """Classes with before and after filled in at the borders of tasks; -1 for the first and the last of all.

    Only the first and last row of each task come together for that.
    """
    rows = classes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(neighbours, T.StructType([*classes.schema.fields, *[T.StructField(c, COMMON) for c in ("before", "after", "task")]]))
    rows = space.save(rows, "sorted")

    @F.udf(COMMON)
    def shared(a, b):
        return common(a, b)

    order = Window.orderBy("task", F.col("before").isNotNull())
    edge = rows.where("before is null or after is null").select("name", "path", "task", "before", "after")
    met = edge.select("name", "path", F.lag("path").over(order).alias("p"), F.lead("path").over(order).alias("n"), "before", "after")
    found = met.select("name", F.coalesce("before", shared("p", "path")).alias("b"), F.coalesce("after", shared("path", "n")).alias("a"))
    return space.save(rows.join(F.broadcast(found), "name", "left").withColumns({"before": F.coalesce("before", "b"), "after": F.coalesce("after", "a")}).drop("a", "b", "task"), "bordered")


def ender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each name, joined by commas, from rows (name, conv) sorted by both."""
    name, digest = None, None
    for batch in batches:
        found = []
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own == name:
                digest.update(b",%d" % conv)
                continue
            if digest:
                found.append((name, digest.hexdigest()))
            name, digest = own, hashlib.sha256(b"%d" % conv)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.string()))], ["name", "ends"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends"])


def upto(depth: Column) -> Column:
    """Words of the turns up to a depth."""
    return F.when(depth > 0, F.element_at("total", depth)).otherwise(F.lit(0).cast("long"))


def at(depth: Column) -> Column:
    """The name of the path's node at a depth; the root's is empty."""
    return F.when(depth > 0, F.element_at("path", F.greatest(depth, F.lit(1)))).otherwise(F.lit(b""))


def build(paths: DataFrame) -> DataFrame:
    """The trie's nodes from ``paths`` (conv, marks, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node.

    node is the node's name (hex), empty for the root.
    """
    space = Workspace(paths.sparkSession, "trie")
    named = space.save(paths.mapInArrow(namer, NAMED).withColumn("name", F.coalesce(F.element_at("path", F.when(F.size("path") > 0, -1)), F.lit(b""))), "named")
    sizes = named.groupBy("name").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    # one row of each name carries the path
    classes = named.join(sizes, ["name", "conv"]).select("path", "name", "n", "conv", F.size("path").alias("depth"), "total")
    many = named.join(sizes.where("n > 1").select("name"), "name", "left_semi").select("name", "conv")
    ends = many.repartition("name").sortWithinPartitions("name", "conv").mapInArrow(ender, "name binary, ends string")
    classes = space.save(classes.join(ends, "name", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.col("conv").cast("string"), 256))).select("path", "name", "n", "conv", "depth", "total", "ends"), "classes")
    classes = bordered(space, classes).withColumn("leaf", (F.col("after") < F.col("depth")).cast("long"))

    # points: the root, common prefixes of neighbours, and ends
    points = classes.select(F.explode(F.array("before", "depth")).alias("d"), "path").where("d > 0").select(at(F.col("d")).alias("node")).distinct()
    shared = F.greatest("before", "after")
    steps = classes.where(shared > 0).select("name", "path", F.explode(F.sequence(F.lit(1), shared)).alias("d")).select("name", "d", at(F.col("d")).alias("node"))
    marks = steps.join(points, "node", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list("d")).alias("marks"))
    marked = classes.join(marks, "name", "left")
    tree = space.save(marked.withColumn("marks", F.array_sort(F.array_union(F.coalesce("marks", F.array().cast("array<int>")), F.array(F.lit(0), "depth")))), "tree")

    # every class adds to the points on its path
    own = tree.select("*", F.explode("marks").alias("d")).select(
        at(F.col("d")).alias("node"), "n", "conv", "leaf", ((F.col("before") <= F.col("d")) & (F.col("depth") > F.col("d"))).cast("long").alias("child"),
        (F.col("n") * (F.element_at("total", F.when(F.size("total") > 0, -1)) - upto(F.col("d")))).alias("all"),
        (F.element_at("total", F.when(F.size("total") > 0, -1)) - upto(F.greatest("before", "d"))).alias("once"),
    )
    sums = own.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"), (F.coalesce(F.sum("all"), F.lit(0)) - F.coalesce(F.sum("once"), F.lit(0))).alias("below"))
    sums = space.save(sums, "points")

    # owned edges, then their nodes
    place = F.expr("filter(marks, x -> x > before)")
    edges = tree.withColumn("lower", F.explode(place)).withColumn("upper", F.expr("array_max(filter(marks, x -> x < lower))"))
    edge = edges.select(at(F.col("lower")).alias("node"), F.when(F.col("lower") > 0, at(F.col("upper"))).alias("above"), "lower", F.coalesce("upper", F.lit(-1)).alias("upper"), "path", "total", F.when(F.col("lower") == F.col("depth"), F.col("ends")).alias("ends"))
    joined = edge.join(sums, "node").join(sums.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv")), "above", "left")
    last = F.col("depth") == F.col("lower")
    nodes = joined.withColumn("depth", F.explode(F.sequence(F.col("upper") + 1, F.col("lower"))))
    saved = F.col("below") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * (upto(F.col("lower")) - upto(F.col("depth") - 1))).otherwise(F.lit(0))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("upper") + 1, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.cast("long").alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.lower(F.hex(at(F.col("depth")))).alias("node"),
    )

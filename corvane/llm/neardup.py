"""MinHash near-dedup: bottom-k sketches of one hash function.

A document's set holds the distinct hashes of its word shingles. Documents of equal sets are one
class, represented by its smallest row. Of each representative's set the ``K`` smallest values are
retained. The inverted lists hold runs of three adjacent retained values, so that the lists of a
passage that many documents share stay short; two sets at a similarity of 0.85 share no run with a
probability of about 0.63**40, 1e-8, and copies with fewer changes less. Sets below SMALL are in
lists of the contents of hash partitions, at least half of which no difference that a link allows
can touch; sets of up to TINY values in those of the exact prefix. Sets near a border are in both kinds.

1. Lists generate overlaps, and no step emits all pairs of a list. Every row meets the smallest row
   of its lists; then, in each list, the members outside its largest family meet one member of that
   family and the smallest of themselves; then they meet the members of all other families. A signature of one bit for each
   of 128 bins and the union sketch's estimate, both far below the threshold, filter what meets;
   what passes is a family.
2. Within a family the full sets decide. A family is dealt in blocks of bounded size, each pair of
   blocks is one unit of work that intersects its sets as bit rows and gives links that span its
   components, at most one less than its members. So a family of thousands makes few rows.

Components of those links are the groups. No link between different texts that could change a group
is sampled or capped; that lists and filters miss one is a matter of chance, about 1e-8 at a similarity
of 0.85 and under 1e-6 at 0.8. Null and empty texts have an empty set and are linked with nothing.
Rows that repeat an id, or have none, are one document each and share the component of their set; component ids are
the smallest doc_id reachable. An empty table gives an empty result. Other columns are kept out of the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, Workspace, emitted, serving, texts, words

#: Sets below SMALL are found by hash partitions (up to TINY by the exact prefix), the others by runs of RUN retained values.
TINY, SMALL, RUN, K = 10, 48, 3, 40
#: How far under the threshold an estimate may stay, so that a family holds its heavily changed copies too: over six deviations.
MARGIN = 0.4
#: Bits of two signatures of 128 that may differ: over four deviations above what 0.8 gives.
DIFFER = 26
#: Members and set values of a block of a family.
BLOCK_ROWS, BLOCK_VALUES = 1500, 1_500_000
#: Rows that may be sent to every task: ids and digests, about 10 MB; row numbers alone, about 25 MB.
SENT, SENT_NUMBERS = 200_000, 1_000_000
#: Cached words of a task; a worker keeps none between tasks.
CACHED = 500_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


KNOWN = Hashes()


def forget() -> None:
    """Called by name from tasks, which would else empty a copy of KNOWN."""
    KNOWN.clear()


CACHES["neardup"] = forget


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, one of them all."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(KNOWN.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = scramble(out * MIX[0] + h[i : len(h) - width + 1 + i] * MIX[1] + MIX[2])
    return np.unique(out)


def keys(s: np.ndarray, threshold: tuple[int, int]) -> list[int]:
    """Values under which a set stands in the inverted lists, as signed 64 bit."""
    size, (num, den) = len(s), threshold
    found: list[np.ndarray] = []
    if size * num <= TINY * den:  # it may link to a set of at most TINY
        found.append(s[: size - -(-size * num // den) + 1])
    if size * den > TINY * num and size * num <= SMALL * den:
        band = int(math.log(size) / math.log(den / num))
        for shared in (band, band + 1):  # two linked sets have one of their bands in common
            most = math.ceil((den / num) ** (shared + 1))
            parts = 2 * (2 * most * (den - num) // (den + num) + 1)
            own = (scramble(s + MIX[4]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            bounds = np.flatnonzero(np.diff(own[order], prepend=-1))
            content = np.add.reduceat(scramble(s + MIX[2])[order], bounds)
            found.append(scramble(content + np.array([shared], np.uint64) * MIX[0] + own[order][bounds].astype(np.uint64) * MIX[1]))
    if size * den >= SMALL * num:
        low = s[:K]
        run = low[: len(low) - RUN + 1].copy()
        for i in range(1, RUN):
            run = scramble(run * MIX[0] + low[i : len(low) - RUN + 1 + i])
        found.append(run)
    return np.unique(np.concatenate(found)).view(np.int64).tolist() if found and size else []


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits: of each bin, by the hash, one bit of its smallest value; 0 for an empty bin."""
    mixed = np.sort(scramble(s ^ MIX[1]))  # bins are the high bits, so each bin's smallest comes first
    bins = (mixed >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    bits = np.zeros(128, np.uint8)
    bits[bins[first]] = (scramble(mixed[first]) & np.uint64(1)).astype(np.uint8)
    high, low = np.packbits(bits).view(">i8").tolist()
    return high, low


SKETCHED = "doc_id long, row long, n long, digest binary, high long, low long, sketch array<long>, keys array<long>"
SKETCHED_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "row", "n")] + [("digest", pa.binary()), ("high", pa.int64()), ("low", pa.int64()), ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def sketcher(n: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("neardup")
        row = TaskContext.get().partitionId() << 40

        def rows() -> Iterator[tuple]:
            nonlocal row
            for batch in batches:
                numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else range(row, row + batch.num_rows)
                row += batch.num_rows
                for doc_id, text, number in zip(batch.column(0).to_pylist(), texts(batch), numbers):
                    s = shingles(text, n)
                    digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    yield doc_id, number, len(s), digest, *(signature(s) if len(s) else (0, 0)), s[:K].view(np.int64).tolist(), keys(s, threshold)

        yield from emitted(rows(), SKETCHED_ARROW, 2_000)
        forget()

    return run


SETS = pa.schema([("digest", pa.binary()), ("set", pa.binary())])


def setter(n: int):
    """Full sets of the rows whose set has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("neardup")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for digest, text in zip(batch.column(0).to_pylist(), texts(batch)):
                    s = shingles(text, n).tobytes()
                    if xxhash.xxh3_128_digest(s) == digest:
                        yield digest, s

        yield from emitted(rows(), SETS, 500)
        forget()

    return run


def own_setter(n: int):
    """Full sets of all rows, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("neardup")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for text in texts(batch):
                    if len(s := shingles(text, n).tobytes()):
                        yield xxhash.xxh3_128_digest(s), s

        yield from emitted(rows(), SETS, 500)
        forget()

    return run


def spanning(members: list[tuple[int, int, np.ndarray]], threshold: tuple[int, int], across: bool) -> list[tuple[int, int]]:
    """Links that span the components of (row, block, set) members; ``across``: only pairs of different blocks count."""
    num, den = threshold
    members = sorted(members, key=lambda m: (len(m[2]), m[0]))
    sizes = np.array([len(m[2]) for m in members])
    blocks = np.array([m[1] for m in members])
    _, inverse, counts = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    bits = np.zeros((len(members), max(-(-int((counts > 1).sum()) // 64), 1)), np.uint64)
    held = counts[inverse] > 1
    owner, at = np.repeat(np.arange(len(members)), sizes)[held], place[inverse[held]]
    np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(members) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        if end <= i + 1:
            continue
        shared = np.bitwise_count(bits[i] & bits[i + 1 : end]).sum(1, dtype=np.int64)
        linked = shared * den >= (sizes[i] + sizes[i + 1 : end] - shared) * num
        if across:
            linked &= blocks[i + 1 : end] != blocks[i]
        for j in np.flatnonzero(linked).tolist():
            x, y = find(i), find(i + 1 + j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((members[i][0], members[i + 1 + j][0]))
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linker(threshold: tuple[int, int]):
    """Over rows sorted by unit (family, i, j): the spanning links of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("neardup")

        def rows() -> Iterator[tuple]:
            unit, members = None, []
            for batch in batches:
                for family, i, j, row, block, raw in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if (family, i, j) != unit:
                        if len(members) > 1:
                            yield from spanning(members, threshold, unit[1] != unit[2])
                        unit, members = (family, i, j), []
                    members.append((row, block, np.frombuffer(raw, np.uint64)))
            if len(members) > 1:
                yield from spanning(members, threshold, unit[1] != unit[2])

        yield from emitted(rows(), LINKS)

    return run


def alike(a: Column, b: Column) -> Column:
    """Share of the union's K smallest values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def settled(links: DataFrame) -> bool:
    """Whether each node has one link and no link leads to a node that has one itself."""
    once = links.groupBy("a").agg(F.count("*").alias("n"))
    led = links.select(F.col("b").alias("a")).join(once.select("a"), "a", "left_semi")
    return once.where("n > 1").select("a").unionAll(led).count() == 0


def components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): alternating large-star and small-star steps.

    Each step is two aggregations with map-side combining and two joins; the loop ends when every node
    is linked to its root alone, after about log2 of the longest chain. Only a count reaches the driver.
    """
    links = space.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    turn = 0
    while not settled(links):
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.unionAll(least.where("m < a").select("a", F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a != b")
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        turn += 1
        links = space.save(small, f"{name}-{turn}")
        space.drop(f"{name}-{turn - 1}")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(space: Workspace, docs: DataFrame, families: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Spanning links (a, b) of rows, from families (row, root, doc_id, digest, n) of at least two rows."""
    wanted = space.save(families, "wanted")
    # by row number, where the rows have one; else by id
    known = F.col("row" if "row" in docs.columns else "doc_id").alias("_known")
    ids = wanted.select(known, "digest").where("_known is not null")
    small = F.broadcast(ids) if ids.count() <= SENT else ids
    full = docs.select(known, "text").join(small, "_known").select("digest", "text").mapInArrow(setter(n), "digest binary, set binary")
    if "row" not in docs.columns:  # rows without an id are met by the digest of their own set
        nameless = wanted.where("doc_id is null").select("digest")
        nameless = F.broadcast(nameless) if nameless.count() <= SENT else nameless
        own = docs.where("doc_id is null").select("text").mapInArrow(own_setter(n), "digest binary, set binary")
        full = full.unionAll(own.join(nameless, "digest", "left_semi"))
    full = full.dropDuplicates(["digest"])
    sizes = wanted.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int").alias("blocks"))
    members = full.join(wanted.join(sizes, "root").select("digest", "row", "root", "blocks"), "digest")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "block", "set")
    units = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return space.save(units.mapInArrow(linker(threshold), "a long, b long"), "links")


def group(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    threshold: (numerator, denominator) of the smallest similarity that links, 0.8 at least: SMALL, RUN, K and
    DIFFER are set for that, and a lower one raises ValueError.
    row_col: a stored number of each row, unique and not null. The result has it as ``row``, and kept is then true for
    one row of each group, whether ids are null or repeated: the first by number of those with the smallest id.
    Each row without words is a group of its own.
    """
    space = Workspace(docs.sparkSession, "neardup")
    number = [docs[row_col].cast("long").alias("row")] if row_col else []
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *number)
    num, den = threshold
    if 5 * num < 4 * den:
        raise ValueError("similarities under 0.8 need longer sketches")
    least = num / den - MARGIN
    rows = space.save(docs.mapInArrow(sketcher(shingle, threshold), SKETCHED), "rows")
    reps = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n")).alias("first")).select("digest", "first.doc_id", "first.row", "first.n")
    reps = space.save(reps, "reps")

    def few(numbers: DataFrame, name: str) -> DataFrame:
        """Row numbers, sent to all tasks if they are few enough, so that sketches needn't be shuffled to meet them."""
        kept = space.save(numbers, name)
        return F.broadcast(kept) if kept.count() <= SENT_NUMBERS else kept

    copies = few(rows.where("n > 0").select("row").join(reps.select("row"), "row", "left_anti"), "copies")
    signed = rows.where("n > 0").join(copies, "row", "left_anti")
    listed = signed.select("row", "n", "high", "low", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.count("*").alias("members"), F.min("row").alias("first")).where("members > 1").select("key", "first")
    lists = space.save(listed.join(shared, "key"), "lists")
    met = few(lists.select("row").distinct(), "met")
    sketches = space.save(rows.join(met, "row", "left_semi").select("row", "n", "sketch"), "sketches")
    fits = (F.least("n_a", "n_b") * den) >= (F.greatest("n_a", "n_b") * num)

    def near(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        b = sketches.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        return pairs.join(a, "a").join(b, "b").where(fits & (alike(F.col("s_a"), F.col("s_b")) >= least)).select("a", "b")

    def mixed_lists(roots: DataFrame, name: str) -> DataFrame:
        """The rows of lists that more than one family is in, with the largest one there as top and a member of it."""
        named = lists.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"), F.min("row").alias("least"))
        top = sizes.groupBy("key").agg(F.max(F.struct("size", "root", "least")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.root").alias("top"), F.col("top.least").alias("lead"))
        return space.save(named.join(top, "key"), name)

    # each row meets one smaller row; two steps along those links name the families for a start
    star = lists.groupBy("row").agg(F.min("first").alias("first")).where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    links = space.save(near(star), "star")
    above = links.select(F.col("b").alias("a"), F.col("a").alias("above"))
    mixed = mixed_lists(links.join(above, "a", "left").select(F.col("b").alias("row"), F.coalesce("above", "a").alias("root")), "one-mixed")
    apart = mixed.where("root != top")
    second = apart.groupBy("key").agg(F.min("row").alias("second"))
    again = apart.select(F.col("lead").alias("a"), F.col("row").alias("b")).unionAll(apart.join(second, "key").where("row != second").select(F.col("second").alias("a"), F.col("row").alias("b"))).distinct()
    links = links.unionAll(space.save(near(again), "again"))
    roots = space.save(components(space, links, "one-cc"), "one-roots").withColumnRenamed("node", "row")
    mixed = mixed_lists(roots, "two-mixed")
    apart = mixed.where("root != top").select("key", *[F.col(c).alias(f"{c}_b") for c in ("row", "root", "n", "high", "low")])
    members = mixed.select("key", "top", *[F.col(c).alias(f"{c}_a") for c in ("row", "root", "n", "high", "low")])
    differ = F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b"))) + F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b")))
    once = (F.col("root_a") == F.col("top")) | (F.col("row_a") < F.col("row_b"))
    cross = members.join(apart, "key").where((F.col("root_a") != F.col("root_b")) & fits & (differ <= DIFFER) & once)
    cross = space.save(near(cross.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()), "cross")
    if cross.head(1):
        roots = space.save(components(space, links.unionAll(cross), "family-cc"), "families").withColumnRenamed("node", "row")
    exact = linked(space, docs, reps.join(roots, "row"), shingle, threshold)
    final = space.save(components(space, exact, "group-cc"), "groups").withColumnRenamed("node", "row")
    placed = reps.join(final, "row", "left").withColumn("root", F.coalesce("root", "row"))
    ids = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("first"))
    by_class = space.save(placed.join(ids, "root").select("digest", "component_id", "first"), "classes")
    for name in ("lists", "sketches", "one-mixed", "two-mixed", "wanted"):
        space.drop(name)
    out = rows.select("doc_id", "row", "n", "digest").join(by_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    if row_col:
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.coalesce("first", "row") == F.col("row")).alias("kept"), "row")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

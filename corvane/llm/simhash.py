"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 values of the
document's word shingles, repeats included. Fingerprints link at RADIUS differing bits or fewer.

1. Equal fingerprints are one class; from here on each is handled once, however many documents have it.
2. Every fingerprint emits all variants within half the radius, and variants are shuffled. Two balls of half the
   radius meet in the middle. A radius of 3 has no whole half: fingerprints of an even number of ones take the
   variants of up to one flipped bit, the odd ones up to two. Links of one or three bits join different parities,
   so 1 + 2 bits reach them; links of two bits join equal parities, and 1 + 1 bits do.
3. All members of a variant that are one flip away from it, or none, are linked with each other and with those two
   flips away. So the first of them is linked with each other member and the pair verified: a variant of m
   members gives m - 1 links and no pair more, and no link that could change a group is lost. A variant
   whose members all are two flips away gives nothing: their pairs of two bits meet elsewhere.
4. Components of those links are the groups.

A ball of two flips has 2081 variants, so a sieve first leaves out fingerprints that have no neighbour. It is ball
hashing as well: without the block of bits that holds most differing bits, at most two of three are left, and
balls of one flip meet. Each fingerprint emits 4 x 49 variants of 48 bits; those that share none have no link.

Null texts count as empty; a text without words has the fingerprint zero, linked like any other. Texts of fewer
words than a shingle are one shingle. Rows without an id are linked, but name no group unless none of its rows has an
id; then component_id is null. Repeated ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, texts, words
from .neardup import components

RADIUS = 3
#: Fixed value: the seed of XXH64.
SEED = 42
#: Blocks of bits, one of which the sieve leaves out at a time.
BLOCKS = 4
#: Shingles hashed at a time, so that a long text needs little memory.
CHUNK = 255 * 256

LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Eight counters of a byte share a lane, summed 255 at a time."""
    lanes = (hashes[None, :] >> SHIFTS) & LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=1)
    return sums.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T.ravel()


def fingerprint(text: bytes, n: int) -> int:
    own = words(text)
    if not own:
        return 0
    total = max(1, len(own) - n + 1)
    grams = iter([b" ".join(own)]) if len(own) < n else map(b" ".join, zip(*(islice(own, i, None) for i in range(n))))
    counts = np.zeros(64, np.int64)
    for begin in range(0, total, CHUNK):
        size = min(CHUNK, total - begin)
        counts += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, islice(grams, size), repeat(SEED)), np.uint64, size))
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprinter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(text, n) for text in texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return run


def flip(bit: str) -> Column:
    return F.expr(f"shiftleft(1L, {bit})")


def sharers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of rows (variant, fp), sorted by variant, whose variant the row before or after has too.

    One row is held back from batch to batch: a variant of any number of members passes through.
    """
    key, value, open_ = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        value = np.concatenate([value, batch.column(1).to_numpy()])
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        shared = np.concatenate([[open_], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(value[:-1][shared[:-1]]))], ["fp"])
        key, value, open_ = key[-1:], value[-1:], bool(shared[-1:].any())
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array(value)], ["fp"])


def sieved(prints: DataFrame) -> DataFrame:
    """The fingerprints that share a variant of the sieve with another."""
    wide = 64 // BLOCKS
    blocks = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    flips = blocks.select("fp", "block", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).where(f"bit < 0 or bit div {wide} != block")
    rest = F.expr(f"fp & ~shiftleft({(1 << wide) - 1}L, {wide} * block)")
    keyed = flips.select(F.when(F.col("bit") < 0, rest).otherwise(rest.bitwiseXOR(flip("bit"))).alias("variant"), "fp")
    return keyed.repartition("variant").sortWithinPartitions("variant").mapInArrow(sharers, "fp long").distinct()


def ball(prints: DataFrame) -> DataFrame:
    """(fp, variant, far): all variants of up to one flipped bit, of up to two for an odd number of ones; far: whether two are flipped."""
    odd = F.bit_count("fp") % 2 == 1
    first = prints.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    both = first.select("fp", "i", F.explode(F.when(odd & (F.col("i") >= 0), F.sequence("i", F.lit(63))).otherwise(F.array("i"))).alias("j"))
    one = F.col("fp").bitwiseXOR(flip("i"))
    variant = F.when(F.col("i") < 0, F.col("fp")).when(F.col("i") == F.col("j"), one).otherwise(one.bitwiseXOR(flip("j")))
    return both.select("fp", variant.alias("variant"), (F.col("i") != F.col("j")).alias("far"))


def links(prints: DataFrame) -> DataFrame:
    """Distinct (a, b): in each variant the first member that is near it, with each other member."""
    own = Window.partitionBy("variant").orderBy("far", "fp").rowsBetween(Window.unboundedPreceding, 0)
    met = ball(prints).withColumn("lead", F.first(F.struct("far", "fp")).over(own))
    pairs = met.where("not lead.far and lead.fp != fp").select(F.col("lead.fp").alias("a"), F.col("fp").alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def group(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, kept for every row of ``docs``: links at RADIUS differing bits or fewer.

    component_id is the smallest id that links reach; kept is true where it is the row's own.
    """
    space = Workspace(docs.sparkSession, "simhash")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = space.save(docs.mapInArrow(fingerprinter(shingle), "doc_id long, fp long"), "rows")
    classes = space.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    near = space.save(sieved(classes.select("fp")).repartition("fp"), "near")
    found = space.save(links(near), "links")
    roots = components(space, found, "cc").withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = rows.join(space.save(named, "named"), "fp")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hex16.alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))

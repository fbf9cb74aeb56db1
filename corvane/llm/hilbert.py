"""Sharding by a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each: the text's size on a log2 scale, its
language and its source by hash. The curve index of the cell orders the rows, so a run of rows spans
a narrow box in every dimension and a reader's filters prune whole shards by their min and max. Rows
of equal texts share the group's smallest language and source, hence the cell, and stand side by side.

The order is a range partitioning with a sort inside the partitions; the rank of a row is its
position there plus the rows of the partitions before, whose counts are as many as partitions. The
law is ``rows``: cutting the ranks into equal runs leaves counts at most one apart, whatever the sizes
of the groups, so a group is cut only where a boundary falls into it. Metadata of a group are met by
digest and SALTS parts, so that the copies of one text are dealt over many tasks.

A null text has size 1 and no CRC bytes; null metadata is a value of its own; repeated rows each take
a slot; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Parts that the copies of one text are dealt over.
SALTS = 32

def hilbert_index(dimensions: list[Column], bits: int) -> list[tuple[str, Column]]:
    """Named steps that turn axes into the curve index, by the public transpose algorithm; the last is the index.

    Each step is (column name, expression over earlier ones), so that no expression is repeated.
    """
    n = len(dimensions)
    names = [f"_x{i}_0" for i in range(n)]
    steps = list(zip(names, dimensions))
    made = 0

    def put(i: int, value: Column) -> None:
        nonlocal made
        made += 1
        names[i] = f"_x{i}_{made}"
        steps.append((names[i], value))

    x = lambda i: F.col(names[i])
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = x(i).bitwiseAND(F.lit(q)) != 0
            if i == 0:
                put(0, F.when(on, x(0).bitwiseXOR(F.lit(p))).otherwise(x(0)))
                continue
            swap = x(0).bitwiseXOR(x(i)).bitwiseAND(F.lit(p))
            first, other = F.when(on, x(0).bitwiseXOR(F.lit(p))).otherwise(x(0).bitwiseXOR(swap)), F.when(on, x(i)).otherwise(x(i).bitwiseXOR(swap))
            put(0, first)
            put(i, other)
        q >>= 1
    for i in range(1, n):
        put(i, x(i).bitwiseXOR(x(i - 1)))
    t = F.lit(0)
    q = 1 << (bits - 1)
    while q > 1:
        t = F.when(x(n - 1).bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
        q >>= 1
    steps.append(("_t", t))
    for i in range(n):
        put(i, x(i).bitwiseXOR(F.col("_t")))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(x(i), b).bitwiseAND(F.lit(1)).cast("long")
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return [*steps, ("_curve", index)]


def with_index(df: DataFrame, dimensions: list[Column], bits: int) -> DataFrame:
    """``df`` with _curve. dimensions: int columns from 0 to 2**bits - 1."""
    kept = df.columns
    for name, value in hilbert_index(dimensions, bits):
        df = df.withColumn(name, value)
    return df.select(*kept, "_curve")


def hashed(column: str, bits: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("?"))), F.lit(1 << bits)).cast("int")


def half_octave(size: str, bits: int) -> Column:
    """Twice the whole binary logarithm, plus the bit below the highest; 16 bytes and less are 0."""
    digits = F.bin(size)
    level = 2 * (F.length(digits) - 1) + F.when(F.substring(digits, 2, 1) == "1", 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(level - 8, F.lit((1 << bits) - 1)))


def shard(docs: DataFrame, shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every row."""
    spark = docs.sparkSession
    space = Workspace(spark, "shards")
    text = docs[text_col]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    raw = F.coalesce(text, F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), size.alias("size"), F.crc32(raw).alias("crc"), F.unhex(F.sha2(raw, 256)).alias("mark"), *[docs[c].alias(f"_m{i}") for i, c in enumerate(label_cols)])
    rows = space.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = rows.groupBy("mark").agg(F.count("*").alias("of"), *[F.min(f"_m{i}").alias(f"_g{i}") for i in range(2)]).where("of > 1").drop("of")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = rows.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")).join(salted, ["mark", "_salt"], "left")
    named = named.withColumns({f"_d{i}": F.coalesce(f"_g{i}", f"_m{i}") for i in range(2)})
    dims = [half_octave("size", bits), hashed("_d0", bits), hashed("_d1", bits)]
    order = ["_curve", "crc", "mark", "doc_id", "_row"]
    indexed = with_index(named, dims, bits).select("size", *order)
    placed = indexed.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = space.save(placed.withColumn("_at", at), "placed")
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))  # one row per partition
    # shard s holds the ranks from floor(s * total / shards) on
    which = F.expr(f"cast(((_rank + 1) * {shards} - 1) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * cast({total} as bigint)) div {shards}")
    out = placed.withColumn("_part", part).join(starts, "_part").withColumn("_rank", F.col("_before") + place).withColumn("shard", which).withColumn("slot", F.col("_rank") - first)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve"))

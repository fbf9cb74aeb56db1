"""Change feed of a leaderboard: each nation's ten items of highest running revenue, after each arrival day.

Lines are cut into batches by arrival day and written; a Structured Streaming query with state is started for each batch anew,
on one checkpoint, and reads what that batch adds.

1. Within each task the lines' revenue is summed by nation, item and arrival day before it is shuffled, so a hot item
   sends one row a day from each task.
2. applyInPandasWithState keeps a state for each nation and bucket of its items: a serialized dictionary of revenues. A heap
   over it is ordered by revenue, ties by smaller item. After each arrival day the changed items are pushed; what is
   popped and no longer holds, since the item has another revenue by now or is out already, is skipped; the ten valid
   ones are pushed back. Items that come to, change in or leave the bucket's ten are sent on. A nation's ten are among its buckets' tens.
3. A nation's board is the ten best of its buckets' tens, kept in the same way. What comes together there is at most twenty rows a
   bucket and day, whatever the number of lines and items.

The buckets of a nation (a parameter) bound the size of a state: about the nation's items divided by them.

Lines without a known nation or item count for lateness alone. A repeated vendor or item counts once, with its smallest nation
or price. Null numbers: see ``lines``. Days before the first batch's are in the first batch. Revenues are sums of whole
cents in doubles, exact below 2**53 in any order. Without lines the feed is empty.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import Workspace

#: The first day, days of one round of batches, their number, and the days that lines may be late.
FIRST_DAY, SPAN, BATCHES, LATE = 19723, 180, 10, 3
#: Rows of a board.
TOP = 10
#: Buckets of each nation's items.
BUCKETS = 16
#: Sums that a task holds before it sends them on.
HELD = 200_000


def lines(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """(nation, item, cents, day, arrival, batch) of every sale line; nation or item is null where the line doesn't count.

    h is the CRC-32 of the line's four ids joined by commas, null as empty. The day is that of shipping, or FIRST_DAY plus h modulo
    150; the line arrives h modulo 7 days later, every fifth 20 more. Revenue is the amount in cents, else quantity times the
    item's price, else 0; swapped lines take it back.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat(*[x for t in text for x in (t, F.lit(","))][:-1]))
    day = F.coalesce(F.unix_date(F.to_date("shipped_at")), (F.lit(FIRST_DAY) + h % 150).cast("int"))
    sign = F.when(F.col("flag") == "swapped", -1.0).otherwise(1.0)
    cents = sign * F.floor(F.col("amount") * 100 + 0.5)
    units = F.when(F.col("amount").isNull(), sign * F.col("quantity"))
    rows = sale_lines.select("item_id", "vendor_id", cents.alias("cents"), units.alias("units"), day.alias("day"), h.alias("h"))
    arrival = F.col("day") + (F.col("h") % 7).cast("int") + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    rows = rows.withColumn("arrival", arrival).drop("h")
    # both tables grow with the lines: joined by key at every size; written first, so that a skewed key's lines can be split at the join
    space = Workspace(sale_lines.sparkSession, "shop")
    nations = space.save(vendors.groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation")), "nations").hint("merge")
    prices = space.save(items.groupBy(F.col("item_id").alias("item")).agg(F.floor(F.min("price") * 100 + 0.5).cast("double").alias("price")), "prices").hint("merge")
    known = rows.join(nations, "vendor_id", "left").drop("vendor_id").join(prices, rows["item_id"] == prices["item"], "left")
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("arrival") - FIRST_DAY) * BATCHES / SPAN))).cast("int")
    return known.select("nation", "item", F.coalesce("cents", F.col("units") * F.col("price"), F.lit(0.0)).alias("cents"), "day", "arrival", batch.alias("batch"))


PARTIAL = "nation int, item long, arrival int, batch int, cents double"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revenue by nation, item and arrival day of this task's rows, at most HELD sums at a time."""
    keys = ["nation", "item", "arrival", "batch"]
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= HELD:
            held = [merged()]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if rows:
        yield from merged().to_batches()


class Board:
    """The ten best of a dictionary of revenues, by a heap whose stale entries are skipped when they come up."""

    def __init__(self, revenue: dict[int, float], ranked: list[int]):
        self.revenue, self.ranked = revenue, ranked
        self.heap = [(-r, i) for i, r in revenue.items() if r > 0]
        heapq.heapify(self.heap)

    def put(self, item: int, revenue: float | None) -> None:
        """Set an item's revenue; None takes it out."""
        if revenue is None:
            self.revenue.pop(item, None)
            return
        self.revenue[item] = revenue
        if revenue > 0:
            heapq.heappush(self.heap, (-revenue, item))

    def best(self) -> list[int]:
        """The ten highest positive revenues, ties to the smaller item; what was popped validly is pushed back."""
        valid: list[tuple[float, int]] = []
        while self.heap and len(valid) < TOP:
            entry = heapq.heappop(self.heap)
            if self.revenue.get(entry[1]) == -entry[0] and (not valid or valid[-1] != entry):
                valid.append(entry)
        for entry in valid:
            heapq.heappush(self.heap, entry)
        return [i for _, i in valid]


def packed(revenue: dict[int, float], ranked: list[int]) -> bytes:
    """Items in order as differences, revenues as doubles, the board, compressed."""
    items = np.fromiter(revenue.keys(), np.int64, len(revenue))
    cents = np.fromiter(revenue.values(), np.float64, len(revenue))
    order = np.argsort(items)
    gaps = np.diff(items[order], prepend=np.int64(0))
    columns = [np.array([len(items), len(ranked)], np.int64), gaps, cents[order], np.array(ranked, np.int64)]
    # bytes of like weight stand together, which compresses well
    return zlib.compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), 1)


def unpacked(state: bytes) -> tuple[dict[int, float], list[int]]:
    data = zlib.decompress(state)

    def column(begin: int, n: int, kind: type) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, begin).reshape(8, n).T).view(kind).ravel()

    n, ranked = column(0, 2, np.int64).tolist()
    items, cents = np.cumsum(column(16, n, np.int64)), column(16 + 8 * n, n, np.float64)
    return dict(zip(items.tolist(), cents.tolist())), column(16 + 16 * n, ranked, np.int64).tolist()


SENT = "nation int, arrival int, batch int, item long, revenue double, held boolean"


def bucket_days(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What changes in a bucket's ten after each arrival day of a batch; state: the revenues of all of the bucket's items and its ten."""
    board = Board(*(unpacked(state.get[0]) if state.exists else ({}, [])))
    days: dict[tuple[int, int], dict[int, float]] = {}
    for part in rows:
        for item, arrival, batch, cents in zip(part["item"].tolist(), part["arrival"].tolist(), part["batch"].tolist(), part["cents"].tolist()):
            own = days.setdefault((arrival, batch), {})
            own[item] = own.get(item, 0.0) + cents
    out = []
    for (arrival, batch), added in sorted(days.items()):
        for item, cents in added.items():
            board.put(item, board.revenue.get(item, 0.0) + cents)
        ranked = board.best()
        before = set(board.ranked)
        for item in {*before, *ranked}:
            held = item in ranked
            if item in added or held != (item in before):
                out.append((key[0], arrival, batch, item, board.revenue[item], held))
        board.ranked = ranked
    state.update((packed(board.revenue, board.ranked),))
    if out:
        yield pd.DataFrame(out, columns=["nation", "arrival", "batch", "item", "revenue", "held"])


FEED = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"


def nation_days(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The feed of one nation from the changes of its buckets' tens."""
    board = Board({}, [])
    out = []
    for (arrival, batch), day in rows.sort_values(["arrival", "batch"]).groupby(["arrival", "batch"], sort=True):
        now = dict(zip(day["item"].tolist(), day["revenue"].tolist()))
        for item, revenue, held in zip(day["item"].tolist(), day["revenue"].tolist(), day["held"].tolist()):
            board.put(item, revenue if held else None)
        old, ranked = {i: n for n, i in enumerate(board.ranked, 1)}, board.best()
        new = {i: n for n, i in enumerate(ranked, 1)}
        for item in {*old, *new}:
            a, b = old.get(item), new.get(item)
            if a != b:
                change = "enter" if a is None else "exit" if b is None else "move"
                out.append((key[0], arrival, item, batch, change, a, b, int(now[item] if item in now else board.revenue[item])))
        board.ranked = ranked
    return pd.DataFrame(out, columns=["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]).astype({"old_rank": "Int32", "new_rank": "Int32"})


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder of the shared store; False where it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path(source)) and system.rename(path(source), path(target))


def late_bounds(cut: DataFrame) -> dict[int, int]:
    """For each batch the largest day of all batches before it: one row of each batch comes to the driver."""
    largest = {r["batch"]: r["day"] for r in cut.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    return {b: max((d for k, d in largest.items() if k < b and d is not None), default=None) for b in range(1, BATCHES + 1)}


def feed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The change feed of ``rows`` (nation, item, cents, day, arrival, batch), batch by batch in order.

    Returns nation_id, arrival_day, item_id, batch, change (enter, exit, move), old_rank, new_rank, revenue for each item whose rank differs from that of the
    nation's board before; lines whose day is over LATE days below the largest day of earlier batches are left out.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "leaderboard")
    rows.write.partitionBy("batch").parquet(f"{space.path}/cut")
    stored = rows.select("nation", "item", "cents", "day", "arrival", "batch").schema
    bounds = late_bounds(spark.read.schema(stored).parquet(f"{space.path}/cut"))
    early = F.lit(False)
    for batch, largest in bounds.items():
        if largest is not None:
            early |= (F.col("batch") == batch) & (F.col("day") + LATE < largest)
    incoming, sent = f"{space.path}/incoming", f"{space.path}/sent"
    path = spark._jvm.org.apache.hadoop.fs.Path(incoming)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    for batch in range(1, BATCHES + 1):
        if not moved(spark, f"{space.path}/cut/batch={batch}", f"{incoming}/batch={batch}"):
            continue
        lined = spark.readStream.schema(stored).parquet(incoming)
        counted = lined.where(F.col("nation").isNotNull() & F.col("item").isNotNull() & ~early)
        sums = counted.select("nation", "item", "arrival", "batch", "cents").mapInArrow(summed, PARTIAL)
        keyed = sums.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int")).groupBy("nation", "bucket")
        changes = keyed.applyInPandasWithState(bucket_days, SENT, "state binary", "append", GroupStateTimeout.NoTimeout)
        query = changes.writeStream.format("parquet").option("path", sent).option("checkpointLocation", f"{space.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    fields = spark.createDataFrame([], SENT).schema
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(sent)):
        return spark.createDataFrame([], FEED)
    return spark.read.schema(fields).parquet(sent).groupBy("nation").applyInPandas(nation_days, FEED)

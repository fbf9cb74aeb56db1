"""Cleaning, sectioning and chunking of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .folds import folded


def windows(docs: DataFrame, text: str, size: int, overlap: int, least: int = 0, redundant_tail: bool = False) -> DataFrame:
    """One row per character window: start (from 0), chunk_index, chunk. Empty texts have none.

    Without ``redundant_tail`` a last window that lies whole in the one before is left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    stride = size - overlap
    length = F.length(text)
    last = length - 1 if redundant_tail else F.greatest(length - overlap - 1, F.lit(0))
    starts = F.when(length > 0, F.sequence(F.lit(0), last, F.lit(stride)))
    out = docs.select("*", F.posexplode(starts).alias("chunk_index", "start"))
    out = out.withColumn("chunk", F.substring(text, F.col("start") + 1, F.lit(size)))
    return out.where(F.length(F.trim("chunk")) >= least) if least else out


def lines(docs: DataFrame, text: str) -> DataFrame:
    """One row per line: line_no from 0, line."""
    return docs.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_windows(listed: DataFrame, key: str, size: int = 5, overlap: int = 2) -> DataFrame:
    """Windows of lines: start_line, end_line, chunk; the last window ends at the last line."""
    stride = size - overlap
    order = Window.partitionBy(key).orderBy("line_no")
    ahead = order.rowsBetween(0, size - 1)
    total = F.count("*").over(Window.partitionBy(key))
    marked = listed.withColumn("_lines", F.collect_list("line").over(ahead)).withColumn("_total", total)
    starts = (F.col("line_no") % stride == 0) & ((F.col("line_no") == 0) | (F.col("line_no") + overlap < F.col("_total")))
    return marked.where(starts).select(key, F.col("line_no").alias("start_line"), (F.col("line_no") + F.size("_lines") - 1).alias("end_line"), F.array_join("_lines", "\n").alias("chunk"))


def repeated_lines(listed: DataFrame, page: str, group: str, longest: int = 100, share: float = 0.25, least: int = 3) -> DataFrame:
    """(group, line, pages): lines that stand on at least max(least, int(share * pages)) pages of their group."""
    counted = listed.where((F.trim("line") != "") & (F.length("line") <= longest)).select(group, page, F.trim("line").alias("line")).distinct()
    pages = listed.select(group, page).distinct().groupBy(group).agg(F.count("*").alias("_all"))
    found = counted.groupBy(group, "line").agg(F.count("*").alias("pages")).join(pages, group)
    return found.where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("_all") * share))).drop("_all")


def without_repeated(listed: DataFrame, repeated: DataFrame, group: str) -> DataFrame:
    """The lines that aren't repeated ones of their group."""
    noise = repeated.select(group, F.col("line").alias("_noise"))
    return listed.join(noise, (listed[group].eqNullSafe(noise[group])) & (F.trim(listed["line"]) == noise["_noise"]), "left_anti")


def forward_filled(listed: DataFrame, key: str, order: str, value: Column, name: str = "section") -> DataFrame:
    """The last value that isn't null, up to each row."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return listed.withColumn(name, F.last(value, ignorenulls=True).over(run))


def joined_lines(listed: DataFrame, key: str, breaks: Column) -> DataFrame:
    """Lines up to the next break as one: key, island, text."""
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    islands = listed.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(run))
    grouped = islands.groupBy(key, "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return grouped.select(key, "island", F.array_join(F.transform("_l", lambda x: x["line"]), " ").alias("text"))


def parent_blocks(units: DataFrame, key: str, order: str, section: str, size: str, most: int) -> DataFrame:
    """Parents of neighbouring units: a new one at a section change or where ``most`` would be exceeded."""
    rows = units.select(key, order, F.col(section).cast("string").alias("_s"), F.col(size).cast("long").alias("_n"))

    def step(state: tuple | None, s: str | None, n: int | None) -> tuple[tuple, int]:
        n = n or 0
        if state is None:
            return (0, n, s), 0
        parent, used, own = state
        if own != s or used + n > most:
            return (parent + 1, n, s), parent + 1
        return (parent, used + n, s), parent

    return folded(rows, [key], [order, "_s", "_n"], ["_s", "_n"], step, None, "parent", IntegerType()).select(key, order, "parent")


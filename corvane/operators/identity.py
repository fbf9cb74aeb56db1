"""First-wins over several keys at once: in order, and not transitive."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .folds import folded
from .graph import components
from .stored import Tables


def _fold(seen: set | None, keys: Iterable) -> tuple[set, bool]:
    """A row is accepted if none of its keys is an accepted row's."""
    seen = set() if seen is None else seen
    free = seen.isdisjoint(keys)
    if free:
        seen.update(keys)
    return seen, free


def first_of_keys(records: DataFrame, record: str, keys: dict[str, Column], rounds: int = 12) -> DataFrame:
    """The accepted rows' ``record``: in order of ``record`` (unique), a row is accepted unless an accepted row before it has one of its keys.

    A refused row's keys block nothing, so a - b - c, linked by different keys, keeps a and c where components would keep a
    alone. Null and empty keys link nothing; a row without keys is accepted. A null record is an error.

    Each round accepts the rows that come first under all of their keys and takes out the rows that those block; what is
    left goes on. A key of many rows is settled by its first row in one round. A chain gives way by one link a round, so what
    ``rounds`` leave is taken in order within its connected component, whose rows stream through one task.
    """
    space = Tables(records.sparkSession, "first-of-keys")
    listed = [records.select(F.col(record).alias("r"), F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("value")).alias("k")) for kind, key in keys.items()]
    every = space.save(reduce(DataFrame.unionAll, listed).where("k.value is not null and k.value != ''").distinct(), "rows")
    accepted, left = [], every
    for turn in range(rounds):
        first = left.groupBy("k").agg(F.min("r").alias("first"))
        marked = space.save(left.join(first, "k"), f"marked-{turn}")
        won = space.save(marked.groupBy("r").agg(F.min(F.col("r") == F.col("first")).alias("won")).where("won").select("r"), f"won-{turn}")
        accepted.append(won)
        taken = marked.where("r = first").join(won, "r", "left_semi").select("k")
        gone = marked.join(taken, "k", "left_semi").select("r").distinct()
        left = space.save(marked.select("r", "k").join(gone, "r", "left_anti"), f"left-{turn}")
        space.drop(f"marked-{turn}")
        if turn:
            space.drop(f"left-{turn - 1}")
        if left.isEmpty():
            break
    else:
        first = left.groupBy("k").agg(F.min("r").alias("src"))
        edges = left.join(first, "k").where("r != src").select("src", F.col("r").alias("dst"))
        parts = components(edges, left.select(F.col("r").alias("node")))
        rows = left.groupBy("r").agg(F.collect_list("k").alias("ks"))  # one key of each kind
        rows = rows.join(parts, F.col("r") == F.col("node")).select("component", "r", F.transform("ks", lambda k: F.concat_ws("\u0000", k["kind"], k["value"])).alias("ks"))
        won = folded(rows, ["component"], ["r"], ["ks"], _fold, None, "won", BooleanType())
        accepted.append(space.save(won.where("won").select("r"), "won-rest"))
    free = records.select(F.col(record).alias("r")).join(every.select("r").distinct(), "r", "left_anti")
    return reduce(DataFrame.unionAll, [free, *accepted]).select(F.col("r").alias(record))

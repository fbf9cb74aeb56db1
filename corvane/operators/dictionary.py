"""Terms of a dictionary in texts: one automaton per task finds all terms in one pass over a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Terms of one automaton; a larger dictionary is taken in parts, each of which reads the texts once.
PART = 200_000
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LATIN = ALNUM | frozenset(" .&-")


def bounded(text: str, begin: int, end: int) -> bool:
    """Latin terms stand between other signs than letters and digits, not before a point and a digit; others stand anywhere."""
    if not all(c in LATIN for c in text[begin:end]):
        return True
    if begin and text[begin - 1] in ALNUM:
        return False
    after = text[end : end + 2]
    return not after or after[0] not in ALNUM and not (after[0] == "." and len(after) > 1 and after[1].isdecimal() and after[1].isascii())


def anywhere(text: str, begin: int, end: int) -> bool:
    return True


def finder(terms: object, accept: Callable[[str, int, int], bool]):
    """(id, term, start): the first accepted place of each term in each text. terms: a broadcast list of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in terms.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            at, found, starts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                seen: set[str] = set()
                for last, term in automaton.iter(text) if text else ():
                    begin = last - len(term) + 1
                    if term not in seen and accept(text, begin, last + 1):
                        seen.add(term)
                        at.append(row)
                        found.append(term)
                        starts.append(begin)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int32())], [batch.schema.names[0], "term", "start"])

    return run


def found(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, accept: Callable[[str, int, int], bool] = bounded) -> DataFrame:
    """(key, term, start): every term that a text has at a place that ``accept`` takes, with its first such place (from 0).

    Terms and texts meet as they are written: lower both before. Null and empty ones match nothing; repeated terms are one; rows of one key are
    rows of their own. Only (key, term, start) leaves a task: no text is copied or shuffled. The dictionary is counted and sent in parts of at
    most PART terms.
    """
    spark = texts.sparkSession
    distinct = terms.select(F.col(term).alias("term")).where("term != ''").distinct()
    parts = max(1, -(-distinct.count() // PART))
    schema = StructType([*texts.select(key).schema.fields, StructField("term", StringType()), StructField("start", IntegerType())])
    rows = texts.select(key, F.col(text).cast("string"))
    out = []
    for part in range(parts):
        own = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([r["term"] for r in own.collect()])  # about PART terms
        out.append(rows.mapInArrow(finder(sent, accept), schema) if sent.value else spark.createDataFrame([], schema))
    return reduce(DataFrame.unionAll, out)

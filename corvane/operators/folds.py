"""Folds over a key's ordered rows: what a row gets depends on all before it, one small state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Before the first key.
NONE = object()


def folded(rows: DataFrame, key: list[str], order: list[str], columns: list[str], step: Callable, start: object, out: str, kind: DataType) -> DataFrame:
    """``rows`` with a column ``out``: ``step(state, *columns)`` gives the next state and the row's value.

    Rows are dealt by key, sorted by key and order inside their task and stream through it in Arrow batches,
    so a key of any number of rows needs the memory of one batch.
    """
    schema = StructType([*rows.schema.fields, StructField(out, kind)])
    names, arrow = schema.names, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = NONE, None
        for batch in batches:
            lists = {c: batch.column(names.index(c)).to_pylist() for c in {*key, *columns}}
            values = []
            for k, v in zip(zip(*(lists[c] for c in key)), zip(*(lists[c] for c in columns))):
                if k != last:
                    last, state = k, start
                state, value = step(state, *v)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)

"""Ordered folds of each key's rows, streamed: a key's rows are sorted and read one after the other, never gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is handed back.
BATCH = 8_192


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], schema: StructType, finish: Callable[[tuple, object], tuple] | None = None) -> DataFrame:
    """`step(state, row)` gives the next state and an output row, or None; `finish(key, state)` an output row after a key's last one.

    Only the state is kept from row to row, so a key of any size takes the memory of its state; it is one task's work, since each step
    reads what the one before it left."""
    columns = df.columns
    at = [columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        key, state = None, None

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), arrow)], schema=arrow)
            kept.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                now = tuple(row[k] for k in at)
                if now != key:
                    if key is not None and finish:
                        kept.append(finish(key, state))
                    key, state = now, start()
                state, out = step(state, row)
                if out is not None:
                    kept.append(out)
                if len(kept) >= BATCH:
                    yield batch()
        if key is not None and finish:
            kept.append(finish(key, state))
        if kept:
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

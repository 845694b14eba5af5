"""Ordered folds over keyed rows, for operators whose next state depends on the last in a way that window functions cannot say."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], schema: str | StructType, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Fold each key's rows in order: step(state, row) changes the state and gives output rows, finish(state) the last ones.

    Spark hash-partitions by key and sorts; a task streams through its rows with one state at a time, so no group is held in
    memory, however large. Rows come and go as Arrow values: nulls are None, and whole numbers stay whole. The order must be total
    for a repeatable result.
    """
    shape = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    out_schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, row_type = None, None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        for b in batches:
            row_type = row_type or namedtuple("Row", b.schema.names, rename=True)
            places, out = [b.schema.names.index(k) for k in keys], []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                k = tuple(None if values[i] != values[i] else values[i] for i in places)
                if state is None or k != key:
                    if state is not None and finish:
                        out += finish(state)
                    key, state = k, start()
                out += step(state, row_type(*values))
            yield batch(out)
        if state is not None and finish:
            yield batch(finish(state))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)

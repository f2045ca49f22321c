"""Arrow-batch mapping with plain Python rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, schema: str, work: Callable[[], Callable[[dict[str, list]], Iterator[tuple]]], chunk: int = 20_000) -> DataFrame:
    """``work()`` is called once per task and returns a function from one batch (column name to list) to output rows.
    Output leaves in batches of at most ``chunk`` rows, so a task never holds its whole output."""
    st: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(st)

    def run(batches):
        f = work()
        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
            buf: list[tuple] = []
            for row in f(cols):
                buf.append(row)
                if len(buf) >= chunk:
                    yield _batch(buf, target)
                    buf = []
            if buf:
                yield _batch(buf, target)

    return df.mapInArrow(run, st)


def map_task(df: DataFrame, schema: str, work: Callable[[Iterator[dict[str, list]]], Iterator[tuple]], chunk: int = 20_000) -> DataFrame:
    """As ``map_rows``, but ``work`` sees the iterator of all batches of its task (for pre-aggregation)."""
    st: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(st)

    def run(batches):
        buf: list[tuple] = []
        for row in work({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches):
            buf.append(row)
            if len(buf) >= chunk:
                yield _batch(buf, target)
                buf = []
        if buf:
            yield _batch(buf, target)

    return df.mapInArrow(run, st)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

"""Registration of the queries and small shared helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, want: str) -> str:
    """``want``, with underscores in front until no column (in any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def with_fields(df: DataFrame, **new: T.DataType) -> T.StructType:
    """The schema of ``df`` with ``new`` at its end; columns of those names (in any case) give way."""
    names = {n.lower() for n in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in new.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text at most, or one row."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
    pa.default_memory_pool().release_unused()  # a worker stays idle for a while

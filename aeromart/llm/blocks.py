"""Rows of vectors as blocks: arrays of bounded size, one block a row.

A block holds its arrays as raw little-endian bytes, so a stored table of
blocks is read without a value being boxed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound_vector(v: Column) -> Column:
    """Neither null nor with a null or non-finite component (array<double>)."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def as_integers(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component.  Beyond 2**53 doubles have no
    fractions, and beyond what a long holds the cast is an error."""
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def common_size(rows: DataFrame, column: str) -> tuple[int, int, int] | None:
    """(size, rows, largest absolute component) of the most frequent vector
    size, the smaller one of two; None for an empty table."""
    magnitude = F.coalesce(F.array_max(F.transform(column, F.abs)), F.lit(0))
    sizes = rows.groupBy(F.size(column).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(magnitude).alias("most"))
    found = sizes.orderBy(F.desc("n"), "size").first()
    return (int(found["size"]), int(found["n"]), int(found["most"])) if found else None


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list<long> column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task, cut anew into runs of ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()

"""Keyed state over key-sorted partitions.

``co_sorted`` hash-partitions rows by key and sorts each partition, so all rows of a key pass one Python task as one
contiguous run. The helpers below cut the Arrow batches of such a task into runs. Against one grouped call per key
this saves the per-group overhead, which dominates where keys number millions and groups are small; memory is bounded by
the largest run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from quoin.session import width


def co_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    return df.repartition(width(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> np.ndarray:
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    for name in keys:
        column = batch.column(name)
        if n > 1:
            a, b = column.slice(1), column.slice(0, n - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            change[1:] |= differs.to_numpy(zero_copy_only=False)
    change[0] = last is not None and last != tuple(batch.column(k)[0].as_py() for k in keys)
    return change


def key_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs, with the run offsets (length: runs + 1)."""
    pending: list[pa.RecordBatch] = []
    inner: list[int] = [0]  # run starts within pending
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(_changes(batch, keys, last))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if len(starts):
            cut = int(starts[-1])
            pieces = [*pending, batch.slice(0, cut)] if cut else pending
            yield pa.Table.from_batches(pieces), np.array([*inner, *(rows + starts)], dtype=np.int64)
            pending, inner, rows = [batch.slice(cut)], [0], batch.num_rows - cut
        else:
            pending.append(batch)
            rows += batch.num_rows
    if pending:
        yield pa.Table.from_batches(pending), np.array([*inner, rows], dtype=np.int64)


def ints(column: pa.ChunkedArray | pa.Array, null: int) -> np.ndarray:
    """A timestamp, date or integer column as int64, with ``null`` in place of nulls."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    out = pc.fill_null(column.cast(pa.int64()), null)
    return (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out).to_numpy(zero_copy_only=False)


def floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A numeric column as float64, NaN in place of nulls."""
    out = column.cast(pa.float64())
    out = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out
    return out.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)

"""Streamed ingest: late and repeated deliveries end in the same table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the last by ``order``. Partial maxima are built before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def append_batches(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch overwrites its own folder, so one that is delivered again leaves nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write


def windowed_counts(events: DataFrame, time: str, late: str, width: str, slide: str, *by: str) -> DataFrame:
    """Counts and totals per event-time window; events later than ``late`` behind the watermark are dropped by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

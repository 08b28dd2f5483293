"""Continuous periods of a stream of intervals: the interval map as keyed state of a streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators.intervals import OPEN, IntervalMap

STATE = "starts array<bigint>, ends array<bigint>"


def _fold(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    periods = IntervalMap()
    if state.exists:
        for start, end in zip(*state.get):
            periods.insert(start, end, 0)  # only the periods live on, so state is as small as they are
    before = set(zip(periods.starts, periods.ends))
    for batch in batches:
        for start, end in zip(batch["s_"].tolist(), batch["e_"].tolist()):
            periods.insert(int(start), int(end), 0)
    state.update((periods.starts, periods.ends))
    now = list(zip(periods.starts, periods.ends))
    fresh = [(s, e) for s, e in now if (s, e) not in before]
    gone = sorted(before - set(now))
    rows = [(s, e, "period") for s, e in fresh] + [(s, e, "replaced") for s, e in gone]
    out = pd.DataFrame({"t_start": np.array([r[0] for r in rows], dtype="int64"), "t_end": np.array([r[1] for r in rows], dtype="int64"), "kind": [r[2] for r in rows]})
    for i, k in enumerate(keys):
        out.insert(i, f"k{i}", k)
    yield out


def stream_periods(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Changes of the continuous periods per key, in update mode: ``period`` rows that are new and ``replaced`` ones that were merged into
    them. Times are microseconds; an open end is the greatest long. Intervals may come in any order and more than once; those without
    key or start, or that do not end after it, are left out. State holds the disjoint periods alone, never the intervals."""
    rows = intervals.select(*keys, F.unix_micros(F.col(start).cast("timestamp")).alias("s_"), F.coalesce(F.unix_micros(F.col(end).cast("timestamp")), F.lit(OPEN)).alias("e_"))
    for c in (*keys, "s_"):
        rows = rows.where(F.col(c).isNotNull())
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {intervals.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
    out = rows.where("e_ > s_").groupBy(*keys).applyInPandasWithState(_fold, f"{kinds}, t_start bigint, t_end bigint, kind string", STATE, "update", "NoTimeout")
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "t_start", "t_end", "kind")

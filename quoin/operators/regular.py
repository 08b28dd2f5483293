"""Irregular readings onto a regular grid.

Method: iterative singular-spectrum imputation. A source's readings are bucketed by calendar slot; the log series between its first and last
slot is embedded in a Hankel trajectory matrix; the matrix is truncated to its leading singular vectors and averaged back along
the anti-diagonals; missing entries take the result, and this repeats until they settle. Filled slots are marked.

The singular vectors come from the small lag-covariance matrix (window x window), so a round costs the series length times the window.
Readings are reduced to one per source and slot, on the map side first, so a source's group is at most the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from quoin.operators.runs import co_sorted, floats, ints, key_runs

#: Lags of the trajectory matrix, singular vectors kept, the change (in standard deviations) that ends the rounds, and a bound on them far beyond what a
#: series takes: 702 at most, 11 in the mean, of 400 series of the test data.
WINDOW, RANK, ROUNDS, SETTLED = 24, 4, 10_000, 1e-3


def impute(x: np.ndarray, window: int = WINDOW, rank: int = RANK, rounds: int = ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """``x`` with its NaNs filled; the first and last value must be there. A series under eight values, or one without
    variation, is interpolated in a straight line."""
    gaps = np.flatnonzero(np.isnan(x))
    if not len(gaps):
        return x
    there = np.flatnonzero(~np.isnan(x))
    out = x.copy()
    out[gaps] = np.interp(gaps, there, x[there])
    spread = float(np.std(x[there]))
    n = len(x)
    lags = min(window, n // 2)
    if n < 8 or spread <= 1e-12:
        return out
    centre = float(np.mean(x[there]))
    out -= centre
    columns = n - lags + 1
    count = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(lags, columns)).astype(float)[gaps]
    keep = min(rank, lags - 1)
    total = np.empty(n)
    for _ in range(rounds):
        trajectory = np.lib.stride_tricks.sliding_window_view(out, columns)
        _, vectors = np.linalg.eigh(trajectory @ trajectory.T)
        lead = vectors[:, -keep:]
        smooth = lead @ (lead.T @ trajectory)
        total[:] = 0.0
        for i in range(lags):
            total[i : i + columns] += smooth[i]
        new = total[gaps] / count
        change = float(np.max(np.abs(new - out[gaps])))
        out[gaps] = new
        if change < settled * spread:
            break
    out += centre
    out[there] = x[there]
    return out


def _fill(keys: Sequence[str], numbers: np.ndarray, days: np.ndarray, whole: bool, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, keys):
            slots, values = ints(table["slot"], 0), floats(table["value"])
            at, places, filled, marks = [], [], [], []
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                place = np.searchsorted(numbers, slots[begin:end])
                first, last = int(place[0]), int(place[-1])
                dense = np.full(last - first + 1, np.nan)
                dense[place - first] = values[begin:end]
                mark = np.where(np.isnan(dense), 1, 0)
                logs = bool(np.all(values[begin:end] > 0))
                with np.errstate(invalid="ignore"):
                    full = np.exp(impute(np.log(dense))) if logs else impute(dense)
                full[place - first] = values[begin:end]
                if whole:
                    before, after = first, len(numbers) - 1 - last
                    full = np.concatenate([np.full(before, np.nan), full, np.full(after, np.nan)])
                    mark = np.concatenate([np.full(before, 2), mark, np.full(after, 2)])
                    first = 0
                at.append(np.full(len(full), begin))
                places.append(first + np.arange(len(full)))
                filled.append(full)
                marks.append(mark)
            if not at:
                continue
            place, value = np.concatenate(places), np.concatenate(filled)
            names = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(marks).astype(np.int8)), pa.array(["observed", "filled", "outside"])).cast(pa.string())
            out = table.select(list(keys)).take(pa.array(np.concatenate(at))).columns
            out += [pa.array(numbers[place].astype(np.int32)), pa.array(days[place].astype(np.int32)).cast(pa.date32()), pa.array(value, mask=np.isnan(value)), names]
            yield from pa.Table.from_arrays(out, schema=schema).combine_chunks().to_batches(max_chunksize=50_000)

    return task


def regular_grid(
    df: DataFrame, keys: Sequence[str], day: str, value: str, order: Sequence[str], calendar: DataFrame, calendar_day: str, calendar_no: str, *, whole: bool = True
) -> DataFrame:
    """One row per source and calendar slot: keys, slot, day, value and status: "observed", "filled" between the source's first and last
    reading, "outside" (null value) before and after. ``whole=False`` leaves the outside out.

    Of several readings in a slot the last by ``order`` counts, of equal order the greatest value. Rows with a null key, day or value (or NaN), and
    rows on a day that is no slot, are no readings; a source without any reading gets no rows. Values are imputed as logs where all of
    the source's are positive. Repeated rows change nothing; other columns are ignored. The calendar is held by every task: it is the length of a
    grid line and must be short; its numbers must be distinct.
    """
    slots = calendar.select(F.col(calendar_day).alias("slot_day"), F.col(calendar_no).cast("int").alias("slot"))
    lines = slots.where("slot_day IS NOT NULL AND slot IS NOT NULL").orderBy("slot").toPandas()
    numbers = lines["slot"].to_numpy(dtype=np.int64)
    days = np.array([d.toordinal() - 719163 for d in lines["slot_day"]], dtype=np.int64)
    rows = df.select(*keys, F.col(day).alias("slot_day"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("value"), F.struct(*order).alias("o"))
    for c in (*keys, "value"):
        rows = rows.where(F.col(c).isNotNull())
    one = rows.join(slots, "slot_day").groupBy(*keys, "slot").agg(F.max(F.struct("o", "value"))["value"].alias("value"))
    schema = StructType(
        [df.schema[k] for k in keys] + [StructField("slot", IntegerType()), StructField("day", DateType()), StructField("value", DoubleType()), StructField("status", StringType())]
    )
    return co_sorted(one, list(keys), ["slot"]).mapInArrow(_fill(list(keys), numbers, days, whole, to_arrow_schema(schema)), schema)

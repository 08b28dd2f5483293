"""Implausible measurements per source: spikes, stuck values and impossible readings.

Method: each source's log values, one per time, are decomposed by an undecimated Haar wavelet transform, whose finest detail is the
change from one time to the next. Detail coefficients are scaled robustly, by the median absolute coefficient of the source. A spike is
a pair of coefficients beyond ``DETAIL`` scales and of opposite signs, at most ``LONGEST`` times apart, whose sum (the coarser detail
across the pair) all but vanishes: the series is back where it was. A single coefficient is a step, which persists, and is no spike.
Runs of zero detail reveal sticking, and bounds impossible readings.

A source is judged by its distinct readings. Deliveries of the same reading are folded together on the map side before the shuffle, with
the rows of the least and the greatest delivery; only a flagged reading that came more than twice is looked up again in all rows.
So a source delivered over and over stays small in its task; a source's group is bounded by its times and corrected readings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from quoin.operators.runs import co_sorted, floats, ints, key_runs
from quoin.session import cut

#: Robust scales from which a detail coefficient is out of proportion; the longest spike in times; what may be left of a spike after its return.
DETAIL, LONGEST, RETURN = 6.5, 3, 0.5
#: Times around a reading that its windows can touch.
AROUND = 2 * (LONGEST + 1)
MAD = 1.4826  # of a normal distribution
#: Flagged readings delivered more than twice that are broadcast at most; beyond, the join is by shuffle.
BROADCAST = 50_000


@dataclass(frozen=True)
class Rules:
    """``spiky``: measures with spikes. ``sticky``: measures that must not repeat ``run`` times or more while ``active`` is positive. ``positive``,
    ``nonnegative``: bounds. ``within``: (value, low, high)."""

    spiky: Sequence[str]
    sticky: Sequence[str] = ()
    active: str | None = None
    run: int = 5
    positive: Sequence[str] = ()
    nonnegative: Sequence[str] = ()
    within: Sequence[tuple[str, str, str]] = ()

    def measures(self) -> list[str]:
        named = [*self.spiky, *self.sticky, *self.positive, *self.nonnegative, *(m for t in self.within for m in t)]
        return list(dict.fromkeys([*named, *([self.active] if self.active else [])]))


def details(x: np.ndarray, level: int) -> np.ndarray:
    """Undecimated Haar details: mean of each 2^(level-1) values less the mean of as many before; index 0 is the first full pair."""
    half = 1 << (level - 1)
    total = np.concatenate([[0.0], np.cumsum(x)])
    means = (total[half:] - total[:-half]) / half
    return means[half:] - means[:-half]


def scale(detail: np.ndarray, tiny: float = 1e-12) -> float:
    """Robust scale of the details that are not zero; days without movement say nothing about movement."""
    moved = np.abs(detail[np.abs(detail) > tiny])
    return float(MAD * np.median(moved)) if len(moved) else 0.0


def returning(x: np.ndarray, limit: float) -> np.ndarray:
    """Positions of spikes in the series ``x``: within a pair of opposite details beyond ``limit`` that cancel each other, the values beyond ``limit``
    of both borders. Wide pairs come first; a border within a spike is none, for a right value between two spikes is no spike."""
    n = len(x)
    out = np.zeros(n, dtype=bool)
    detail = details(x, 1)  # detail[i] leads from i to i + 1
    for width in range(min(LONGEST, n - 2), 0, -1):
        up, down = detail[: n - 1 - width], detail[width:]
        least = np.minimum(np.abs(up), np.abs(down))
        rest = np.abs(x[1 + width :] - x[: n - 1 - width])  # the sum of the details across
        pair = (least > limit) & (np.sign(up) == -np.sign(down)) & (rest <= RETURN * least) & ~out[: n - 1 - width] & ~out[1 + width :]
        begin = np.flatnonzero(pair) + 1
        sign = np.sign(detail[begin - 1])
        for k in range(width):
            at = begin + k
            beyond = np.minimum(sign * (x[at] - x[begin - 1]), sign * (x[at] - x[begin + width])) > limit
            out[at[beyond]] = True
    return out


def _spikes(days: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows whose value is a spike. ``last``: the row that counts for each day, in day order."""
    out = np.zeros(len(values), dtype=bool)
    ok = values > 0
    kept = last[ok[last]]
    if len(kept) < 4:
        return out
    x, day = np.log(values[kept]), days[kept]
    limit = max(DETAIL * scale(details(x, 1)), 1e-9)
    out[kept] = returning(x, limit)
    own = ok.copy()
    own[kept] = False
    for i in np.flatnonzero(own):  # other readings of a day stand in its place
        low, high = int(np.searchsorted(day, days[i], "left")), int(np.searchsorted(day, days[i], "right"))
        first = max(0, low - AROUND)
        out[i] = returning(np.concatenate([x[first:low], [np.log(values[i])], x[high : high + AROUND]]), limit)[low - first]
    return out


def _stuck(days: np.ndarray, picks: Sequence[np.ndarray], values: np.ndarray, active: np.ndarray, run: int) -> np.ndarray:
    """Rows in runs of ``run`` or more days of one value, but for the first day; a day without activity ends a run."""
    out = np.zeros(len(values), dtype=bool)
    for pick in picks:
        v = values[pick]
        alive = active[pick] > 0
        same = (v[1:] == v[:-1]) & alive[1:] & alive[:-1]  # zero detail
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for begin, end in zip(edge[::2], edge[1::2]):
            if end - begin + 1 >= run:
                rows = slice(np.searchsorted(days, days[pick[begin + 1]], "left"), np.searchsorted(days, days[pick[end]], "right"))
                out[rows] |= values[rows] == v[begin]
    return out


def _judge(keys: Sequence[str], measures: Sequence[str], rules: Rules, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, keys):
            days_all = ints(table["at"], 0)
            all_values = {m: floats(table[m]) for m in measures}
            reasons: dict[int, list[str]] = {}

            def note(rows: np.ndarray, reason: str) -> None:
                for i in rows.tolist():
                    reasons.setdefault(i, []).append(reason)

            with np.errstate(invalid="ignore", divide="ignore"):
                bad = np.zeros(table.num_rows, dtype=bool)
                for m in rules.positive:
                    bad |= all_values[m] <= 0
                for m in rules.nonnegative:
                    bad |= all_values[m] < 0
                for m, low, high in rules.within:
                    bad |= (all_values[m] < all_values[low]) | (all_values[m] > all_values[high])
                note(np.flatnonzero(bad), "impossible")
                for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    days = days_all[begin:end]
                    new = np.flatnonzero(np.diff(days)) + 1
                    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(days)]]) - 1
                    values = {m: v[begin:end] for m, v in all_values.items()}
                    for m in rules.spiky:
                        note(begin + np.flatnonzero(_spikes(days, last, values[m])), f"spike:{m}")
                    active = values[rules.active] if rules.active else np.ones(len(days))
                    picks = [last] if np.array_equal(first, last) else [last, first]
                    for m in rules.sticky:
                        note(begin + np.flatnonzero(_stuck(days, picks, values[m], active, rules.run)), f"stuck:{m}")
            if reasons:
                rows = sorted(reasons)
                out = table.select([*keys, "at", *measures, "n", "least", "most"]).take(pa.array(rows, pa.int64())).columns
                yield from pa.Table.from_arrays([*out, pa.array([reasons[i] for i in rows], pa.list_(pa.string()))], schema=schema).combine_chunks().to_batches()

    return task


def implausible(df: DataFrame, keys: Sequence[str], time: str, required: str, version: Sequence[str], rules: Rules, carry: Sequence[str]) -> DataFrame:
    """The rows with an implausible reading: the keys, ``time``, the ``carry`` columns and ``reasons`` ("impossible", "spike:<measure>",
    "stuck:<measure>"), in one array per row.

    Only rows with non-null keys, ``time`` and ``required`` measure are judged, against each other. Of the readings of one time, the last by
    ``version`` stands for it in the surroundings of others; every reading is judged by its own values, and each row with that reading
    gets the verdict. Null and NaN measures give no verdict. Values that are not positive are no part of the log series. A source
    of fewer than four values has no spikes; the first and last day cannot be spikes, for nothing shows a return. The scale is that of the
    changes that are not zero, so a source that never moves but for one spike has no other behaviour to tell it from. Repeated rows all come
    out; ``carry`` columns may be null, and extra columns are ignored. An empty table gives an empty result.
    """
    measures = rules.measures()
    rows = df
    for c in (*keys, time):
        rows = rows.where(F.col(c).isNotNull())
    clean = {m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")) for m in measures}
    rows = rows.select(*keys, F.col(time).alias("at"), *(clean[m].alias(m) for m in measures), F.struct(*version).alias("version"), F.struct(*carry).alias("carried"))
    rows = rows.where(F.col(required).isNotNull())
    readings = rows.groupBy(*keys, "at", *measures).agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"), F.min("carried").alias("least"), F.max("carried").alias("most"))
    schema = StructType([readings.schema[c] for c in (*keys, "at")] + [StructField(m, DoubleType()) for m in measures] + [readings.schema[c] for c in ("n", "least", "most")] + [StructField("reasons", ArrayType(StringType()))])
    task = _judge(list(keys), measures, rules, to_arrow_schema(schema))
    found = cut(co_sorted(readings, list(keys), ["at", "version"]).mapInArrow(task, schema))  # the flagged readings alone, read twice below
    few = found.where("n <= 2").withColumn("carried", F.explode(F.when(F.col("n") == 1, F.array("least")).otherwise(F.array("least", "most"))))
    out = few.select(*keys, F.col("at").alias(time), "carried.*", "reasons")
    many = found.where("n > 2")
    left = many.count()
    if not left:
        return out
    right = many.drop("n", "least", "most")
    if left <= BROADCAST:
        right = F.broadcast(right)
    same = F.lit(True)
    l, r = rows.drop("version").alias("l"), right.alias("r")  # noqa: E741
    for c in (*keys, "at"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    for m in measures:
        same = same & F.col(f"l.{m}").eqNullSafe(F.col(f"r.{m}"))
    again = l.join(r, same).select(*(F.col(f"l.{c}").alias(c) for c in keys), F.col("l.at").alias(time), "l.carried.*", "r.reasons")
    return out.unionByName(again)

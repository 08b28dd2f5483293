"""Overlapping and gapped time intervals: continuous periods, gaps and overlapping pairs per key.

Method: keyed state holds an ordered map of disjoint periods per key. Every insertion locates the periods it touches by
binary search, merges them and so closes or shifts the gaps between neighbours. Rows reach the state in start order, which makes
an insertion an append in the usual case; any other order gives the same map. Pairs come from the intervals still open at
the insertion, in order of their ends: a binary search finds those that reach beyond the new start, so work is in proportion to pairs.

A hot key is cut into slabs of (start, id). Periods need one visitor a slab: of all earlier intervals, the one that reaches furthest.
Only the first and last period of each slab can continue elsewhere; those edges, two a slab at most, are folded together per
key at the end. Pairs need every earlier interval that reaches into the slab; these visitors are dealt over chunks, each of
which sees all rows of its slab, and a pair is reported where its later start is at home. So no task holds more than about twice
the limit, and no link is lost or doubled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quoin.operators.runs import co_sorted, ints, key_runs
from quoin.operators.slabs import LIMIT, chunked, slab_bounds, slab_of

OPEN = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


class IntervalMap:
    """Disjoint periods in order. Touching intervals share a period."""

    __slots__ = ("starts", "ends", "first", "last")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.first: list[int] = []  # least id of an interval that starts the period
        self.last: list[int] = []  # least id of an interval that ends it

    def insert(self, start: int, end: int, key: int) -> None:
        """Add [start, end)."""
        low = bisect_left(self.ends, start)
        high = bisect_right(self.starts, end, low)
        if low == high:
            self.starts.insert(low, start)
            self.ends.insert(low, end)
            self.first.insert(low, key)
            self.last.insert(low, key)
            return
        if high - low > 1:
            self.ends[low], self.last[low] = self.ends[high - 1], self.last[high - 1]
            for part in (self.starts, self.ends, self.first, self.last):
                del part[low + 1 : high]
        if start < self.starts[low]:
            self.starts[low], self.first[low] = start, key
        elif start == self.starts[low]:
            self.first[low] = min(self.first[low], key)
        if end > self.ends[low]:
            self.ends[low], self.last[low] = end, key
        elif end == self.ends[low]:
            self.last[low] = min(self.last[low], key)


class OpenIntervals:
    """The intervals that are still open, by their ends, while starts ascend."""

    __slots__ = ("ends", "ids")

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.ids: list[int] = []

    def close(self, start: int) -> list[int]:
        """Forgets what has ended by ``start`` and returns the ids of all others, whatever their order."""
        done = bisect_right(self.ends, start)
        if done:
            del self.ends[:done], self.ids[:done]
        return self.ids

    def add(self, end: int, key: int) -> None:
        at = bisect_right(self.ends, end)
        self.ends.insert(at, end)
        self.ids.insert(at, key)


class _Rows:
    """Output columns of one task."""

    def __init__(self, keys: pa.Table) -> None:
        self.keys = keys
        self.at: list[int] = []
        self.kind: list[str] = []
        self.first: list[int | None] = []
        self.second: list[int | None] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.slab: list[int] = []

    def add(self, at: int, kind: str, first: int, second: int, start: int, end: int, slab: int = 0) -> None:
        self.at.append(at)
        self.kind.append(kind)
        self.first.append(first)
        self.second.append(second)
        self.start.append(start)
        self.end.append(end)
        self.slab.append(slab)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.at:
            return
        mask = [e == OPEN for e in self.end]
        out = self.keys.take(pa.array(self.at, pa.int64()))
        for name, column in (
            ("kind", pa.array(self.kind, pa.string())),
            ("id_1", pa.array(self.first, pa.int64())),
            ("id_2", pa.array(self.second, pa.int64())),
            ("t_start", pa.array(self.start, pa.int64())),
            ("t_end", pa.array(np.array(self.end, dtype=np.int64), mask=np.array(mask))),
            ("slab_no", pa.array(self.slab, pa.int64())),
        ):
            out = out.append_column(name, column)
        yield from out.combine_chunks().to_batches()


#: Roles of a row in its slab: the furthest of all earlier intervals, an earlier interval that reaches into the slab, one that starts in it.
CARRY, VISITOR, HOME = 0, 1, 2
#: Rows of a task's output that are kept before they are handed on.
FLUSH = 200_000


def _state(keys: Sequence[str], pairs: bool):
    """One task: runs of (keys, slab_no, chunk_no) in order of start and id. Edges are periods that may continue in another slab."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, [*keys, "slab_no", "chunk_no"]):
            starts, ends, own = (ints(table[c], d).tolist() for c, d in (("t_start", _NONE), ("t_end", OPEN), ("id_1", _NONE)))
            roles, slabs, split, chunks = (ints(table[c], 0).tolist() for c in ("role", "slab_no", "slabs", "chunk_no"))
            names = table.select(list(keys))
            rows = _Rows(names)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                state, visitors, homes, main, before = IntervalMap(), OpenIntervals(), OpenIntervals(), chunks[low] == 0, None
                for i in range(low, high):
                    fact = (starts[i], ends[i], own[i], roles[i])
                    if fact == before:  # an exact duplicate counts once
                        continue
                    before = fact
                    start, end, key, role = fact
                    if main:
                        state.insert(start, end, key)
                    if not pairs or role == CARRY:
                        continue
                    if role == VISITOR:
                        visitors.add(end, key)
                        continue
                    met = visitors.close(start)
                    if main:
                        met = met + homes.close(start)
                        homes.add(end, key)
                    for other in met:
                        if other != key:
                            rows.add(low, "overlap", min(other, key), max(other, key), start, end)
                    if len(rows.at) > FLUSH:
                        yield from rows.batches()
                        rows = _Rows(names)
                n = len(state.starts)
                for k in range(n):
                    if k:
                        a, b = state.last[k - 1], state.first[k]
                        rows.add(low, "gap", min(a, b), max(a, b), state.ends[k - 1], state.starts[k])
                    edge = split[low] > 1 and k in (0, n - 1)
                    rows.add(low, "edge" if edge else "period", state.first[k], state.last[k], state.starts[k], state.ends[k], slabs[low])
            yield from rows.batches()

    return task


def _stitch(keys: Sequence[str]):
    """Folds the edges of a hot key, in slab order. Periods of one slab are apart; those of different slabs may join."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, keys):
            starts, ends = ints(table["t_start"], _NONE).tolist(), ints(table["t_end"], OPEN).tolist()
            first, last = ints(table["id_1"], _NONE).tolist(), ints(table["id_2"], _NONE).tolist()
            slabs = ints(table["slab_no"], 0).tolist()
            rows = _Rows(table.select(list(keys)))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                now = None
                for i in range(low, high):
                    if now and slabs[i] != now[4] and starts[i] <= now[1]:
                        if starts[i] == now[0]:
                            now[2] = min(now[2], first[i])
                        if ends[i] > now[1]:
                            now[1], now[3] = ends[i], last[i]
                        elif ends[i] == now[1]:
                            now[3] = min(now[3], last[i])
                        now[4] = slabs[i]
                        continue
                    if now:
                        if slabs[i] != now[4]:
                            rows.add(low, "gap", min(now[3], first[i]), max(now[3], first[i]), now[1], starts[i])
                        rows.add(low, "period", now[2], now[3], now[0], now[1])
                    now = [starts[i], ends[i], first[i], last[i], slabs[i]]
                rows.add(low, "period", now[2], now[3], now[0], now[1])
            yield from rows.batches()

    return task


def interval_map(df: DataFrame, keys: Sequence[str], start: str, end: str, key: str, *, pairs: bool = True, limit: int = LIMIT) -> DataFrame:
    """Periods, gaps and overlapping pairs of the intervals [start, end) per ``keys``.

    Columns: the keys, kind, id_1, id_2, and the timestamps t_start and t_end. ``period``: a continuous stretch, with the least
    id that starts and the least that ends it; t_end null = open. ``gap``: the stretch between two periods with the ids at
    its borders, smaller first. ``overlap``: two ids whose intervals share more than an instant, smaller first; t_start and t_end
    are those of the interval that came later in start order.

    Null ``end``: open-ended. Rows with a null key column, start or id, and rows whose end is not after their start, cover nothing
    and are left out. Repeated rows count once; equal intervals with different ids overlap. Other columns are ignored, so their names
    cannot clash. An empty table gives an empty result. Start and end must be timestamps.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = df.select(*keys, micros(start).alias("t_start"), micros(end).alias("t_end"), F.col(key).cast("long").alias("id_1"))
    own = own.where(F.col("t_start").isNotNull() & F.col("id_1").isNotNull() & (F.col("t_end").isNull() | (F.col("t_end") > F.col("t_start"))))
    for k in keys:
        own = own.where(F.col(k).isNotNull())
    bounds = slab_bounds(own, keys, "t_start", "id_1", limit)
    if bounds is None:
        placed = own.withColumns({"slab_no": F.lit(0), "chunk_no": F.lit(0), "slabs": F.lit(1), "role": F.lit(HOME)})
    else:
        placed = _slabs(own, bounds, keys, pairs, limit)
    schema = StructType(
        [df.schema[k] for k in keys] + [StructField("kind", StringType()), *(StructField(c, LongType()) for c in ("id_1", "id_2", "t_start", "t_end", "slab_no"))]
    )
    found = co_sorted(placed, [*keys, "slab_no", "chunk_no"], ["t_start", "id_1", "t_end", "role"]).mapInArrow(_state(list(keys), pairs), schema)
    if bounds is not None:
        edges = co_sorted(found.where("kind = 'edge'"), list(keys), ["slab_no", "t_start"]).mapInArrow(_stitch(list(keys)), schema)
        found = found.where("kind <> 'edge'").unionByName(edges)
    return found.drop("slab_no").withColumns({c: F.timestamp_micros(c) for c in ("t_start", "t_end")})


def _slabs(own: DataFrame, bounds: DataFrame, keys: Sequence[str], pairs: bool, limit: int) -> DataFrame:
    """Rows with their slab, its chunk, the number of slabs of the key and the row's role there."""
    joined = own.distinct().join(bounds, list(keys), "left").withColumn("slab_no", slab_of("bounds", "t_start", "id_1"))
    joined = joined.withColumn("slabs", F.coalesce(F.size("bounds"), F.lit(0)) + 1)
    home = joined.withColumn("role", F.lit(HOME))
    hot = joined.where("slabs > 1")
    # of each slab the interval that reaches furthest, and of all slabs before the furthest of those: one row a slab
    end = F.coalesce("t_end", F.lit(OPEN))
    reach = hot.groupBy(*keys, "slab_no", "slabs").agg(F.max(F.struct(end.alias("e"), (-F.col("id_1")).alias("i"), "t_start")).alias("r"))
    before = Window.partitionBy(*keys).orderBy("slab_no").rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.withColumn("r", F.max("r").over(before)).where("r IS NOT NULL")
    carry = carry.select(*keys, F.col("r.t_start").alias("t_start"), F.nullif(F.col("r.e"), F.lit(OPEN)).alias("t_end"), (-F.col("r.i")).alias("id_1"), "slab_no", "slabs", F.lit(CARRY).alias("role"))
    home = home.drop("bounds")
    if not pairs:
        return home.unionByName(carry).withColumn("chunk_no", F.lit(0))
    last = F.when(F.col("t_end").isNull(), F.col("slabs") - 1).otherwise(F.size(F.filter("bounds", lambda b: b["t"] < F.col("t_end"))))
    visits = hot.withColumn("slab_no", F.explode(F.when(last > F.col("slab_no"), F.sequence(F.col("slab_no") + 1, last)))).drop("bounds")
    rows = home.unionByName(visits.withColumn("role", F.lit(VISITOR)))
    # of a pair with a visitor the other side is at home: dealing the visitors out loses none
    dealt = chunked(rows, F.col("role") == VISITOR, [*keys, "slab_no"], F.struct("id_1", "t_start", "t_end"), limit)
    return dealt.unionByName(carry.withColumn("chunk_no", F.lit(0)))

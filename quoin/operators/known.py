"""Attributes as known at event time.

Method: per entity and attribute a persistent search tree. Facts are inserted in the order in which they became known; each
insertion copies the path from the root, so every earlier version stays readable. An event picks the root of its known time by
binary search and looks in that version for the greatest valid_from, at most its valid time, whose validity still runs. Nodes
hold the greatest valid_to below them, which keeps that search logarithmic.

Balance comes from treap priorities that are a hash of the node number, so the trees are the same on every run.

Nodes are flat arrays of 20 bytes; an insertion copies about twice the depth, so ``LIMIT`` facts make some 4 million nodes, 90 MB.

A hot entity is cut into slabs of (known time, id). A fact goes to the slab where it became known and on to later slabs only
until one in which another fact outlives it has begun, so copies stay few where events ask for their own known time; where they
ask for other valid times, all later slabs need it. Each event goes to one slab, and events of a crowded slab are dealt over chunks
that each hold its facts.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, MapType, StructField, StructType

from quoin.operators.runs import co_sorted, floats, ints, key_runs
from quoin.operators.slabs import chunked, slab_bounds, slab_of

#: Rows of one entity that one task takes at most, roughly.
LIMIT = 200_000
OPEN = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


class PersistentTree:
    """Versions of a search tree on (valid_from, order of insertion); node 0 is the empty tree. Nodes refer to their fact by its number."""

    __slots__ = ("fact", "most", "left", "right", "valid", "until", "ids", "rank", "known", "roots")

    def __init__(self) -> None:
        self.fact, self.left, self.right, self.most = array("i", [-1]), array("i", [0]), array("i", [0]), array("q", [_NONE])
        self.valid, self.until, self.ids, self.rank = array("q"), array("q"), array("q"), array("L")  # of each fact
        self.known, self.roots = array("q"), array("i")  # known time of each version, and its root

    def _node(self, fact: int, left: int, right: int) -> int:
        most, here = self.most, self.until[fact]
        if most[left] > here:
            here = most[left]
        if most[right] > here:
            here = most[right]
        self.fact.append(fact)
        self.left.append(left)
        self.right.append(right)
        most.append(here)
        return len(most) - 1

    def _copy(self, path: list[tuple[int, bool]], new: int) -> int:
        """The path from the root, copied, with ``new`` at its end."""
        for node, below in reversed(path):
            new = self._node(self.fact[node], self.left[node], new) if below else self._node(self.fact[node], new, self.right[node])
        return new

    def insert(self, known: int, valid_from: int, valid_to: int, key: int) -> None:
        """A new version at ``known``, which must not be before that of the last version."""
        own = len(self.valid)
        rank = (own * 2654435761 + 97) & 0xFFFFFFFF
        for part, value in ((self.valid, valid_from), (self.until, valid_to), (self.ids, key), (self.rank, rank)):
            part.append(value)
        fact, left, right, valid, ranks = self.fact, self.left, self.right, self.valid, self.rank
        node, path = self.roots[-1] if self.roots else 0, []
        while node and ranks[fact[node]] >= rank:
            below = valid[fact[node]] <= valid_from  # of equal times the later insertion is the greater
            path.append((node, below))
            node = right[node] if below else left[node]
        lower = upper = 0
        inner = []
        while node:  # what lies below is split before and after the new fact
            below = valid[fact[node]] <= valid_from
            inner.append((node, below))
            node = right[node] if below else left[node]
        for node, below in reversed(inner):
            if below:
                lower = self._node(fact[node], left[node], lower)
            else:
                upper = self._node(fact[node], upper, right[node])
        root = self._copy(path, self._node(own, lower, upper))
        if self.known and self.known[-1] == known:
            self.roots[-1] = root
        else:
            self.known.append(known)
            self.roots.append(root)

    def at(self, known: int, valid: int) -> int | None:
        """Id of the fact known at ``known`` with the greatest valid_from <= ``valid`` < valid_to."""
        version = bisect_right(self.known, known) - 1
        if version < 0:
            return None
        fact, most, left, right, begins, until = self.fact, self.most, self.left, self.right, self.valid, self.until
        pending, node = [], self.roots[version]
        while True:
            while node and most[node] > valid:
                if begins[fact[node]] <= valid:
                    pending.append(node)
                    node = right[node]
                else:
                    node = left[node]
            if not pending:
                return None
            node = pending.pop()
            if until[fact[node]] > valid:
                return self.ids[fact[node]]
            node = left[node]


def _select(keys: Sequence[str], carried: Sequence[str], attributes: Sequence[str], schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, [*keys, "slab_no", "chunk_no"]):
            side = ints(table["side"], 0)
            known, valid = ints(table["known"], _NONE).tolist(), ints(table["valid"], _NONE).tolist()
            until, own, kind = ints(table["until"], OPEN).tolist(), ints(table["fact"], _NONE).tolist(), table["attribute"].to_pylist()
            value = floats(table["value"])
            n, width = table.num_rows, len(attributes)
            found = {a: np.full(n, -1, dtype=np.int64) for a in attributes}
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                cut = low + int(np.searchsorted(side[low:high], 1))
                if cut == high or not width:
                    continue
                trees: dict[str, PersistentTree] = {}
                last = None
                for i in range(low, cut):
                    name, fact = kind[i], (known[i], own[i], kind[i], valid[i], until[i])
                    if name not in found or fact == last:  # repeated facts lie beside each other
                        continue
                    last = fact
                    trees.setdefault(name, PersistentTree()).insert(known[i], valid[i], until[i], i)
                for name, tree in trees.items():
                    out = found[name]
                    for i in range(cut, high):
                        if known[i] != _NONE and valid[i] != _NONE and (hit := tree.at(known[i], valid[i])) is not None:
                            out[i] = hit
            events = np.flatnonzero(side == 1)
            if not len(events):
                continue
            out = table.select([*keys, *carried]).take(pa.array(events)).columns
            for name in attributes:
                at = found[name][events]
                hit = at >= 0
                picked = value[np.where(hit, at, 0)]
                out.append(pa.array(picked, mask=~hit | np.isnan(picked)))
                out.append(pa.array(np.array(own, dtype=np.int64)[np.where(hit, at, 0)], mask=~hit))
            yield from pa.Table.from_arrays(out, schema=schema).combine_chunks().to_batches()

    return task


def as_known(
    events: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    attributes: Sequence[str],
    *,
    event_known: str,
    event_valid: str,
    attribute: str,
    known: str,
    valid_from: str,
    valid_to: str,
    value: str,
    fact_id: str,
    limit: int = LIMIT,
) -> DataFrame:
    """Every event with, per attribute ``a``, columns known_a (double) and fact_a (long) of the fact that was known at
    ``event_known`` and valid at ``event_valid``: of several, the one of the latest valid_from, then known last, then greatest id.

    A fact that became known later than the event is never used; one whose valid_to is at or before the event's time has ended;
    null valid_to: still valid. Null value of the chosen fact: known_a null, fact_a set. No fact, or a null event time: both null.
    Rows of facts with a null key, known time, valid_from, attribute or id are left out; events with null keys are kept and find nothing.
    Repeated events stay repeated; repeated facts count once. Event columns keep their names; a clash with known_a or fact_a raises.
    Events or facts may be empty.
    """
    carried = [c for c in events.columns if c not in keys]
    clash = {f"{p}_{a}" for p in ("known", "fact") for a in attributes} & set(events.columns)
    if clash:
        raise ValueError(f"event columns clash with the result's: {sorted(clash)}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    mine = {c: f"e{i}_" for i, c in enumerate(carried)}
    left = events.select(*keys, *(F.col(c).alias(mine[c]) for c in carried), micros(event_known).alias("known"), micros(event_valid).alias("valid"))
    right = facts.where(F.col(attribute).isin(list(attributes))).select(
        *keys, micros(known).alias("known"), micros(valid_from).alias("valid"), micros(valid_to).alias("until"),
        F.col(attribute).alias("attribute"), F.col(value).cast("double").alias("value"), F.col(fact_id).cast("long").alias("fact"),
    )
    for c in (*keys, "known", "valid", "fact"):
        right = right.where(F.col(c).isNotNull())
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)), allowMissingColumns=True)
    tie = F.when(F.col("side") == 1, F.lit(OPEN)).otherwise(F.col("fact"))  # an event sees all facts of its own time
    both = both.withColumn("tie", tie)
    bounds = slab_bounds(both.select(*keys, "known", "tie").where(F.col("known").isNotNull()), keys, "known", "tie", limit)
    if bounds is None:
        placed = both.withColumns({"slab_no": F.lit(0), "chunk_no": F.lit(0)})
    else:
        spot = F.struct(F.lit(0), *(F.col(c) for c in mine.values() if not isinstance(left.schema[c].dataType, MapType)))
        placed = chunked(_slabs(both, bounds, keys, event_known == event_valid), F.col("side") == 1, [*keys, "slab_no"], spot, limit)
    schema = StructType(
        [events.schema[c] for c in (*keys, *carried)] + [StructField(f"{p}_{a}", t) for a in attributes for p, t in (("known", DoubleType()), ("fact", LongType()))]
    )
    task = _select(list(keys), list(mine.values()), list(attributes), to_arrow_schema(schema))
    return co_sorted(placed.drop("tie"), [*keys, "slab_no", "chunk_no"], ["side", "known", "fact", "attribute", "valid", "until"]).mapInArrow(task, schema)


def _slabs(both: DataFrame, bounds: DataFrame, keys: Sequence[str], same: bool) -> DataFrame:
    """Slab numbers. Facts are copied to later slabs. Where events ask for their own known time (``same``), a copy ends with the
    first later slab in which a fact began that outlives this one: from there on it can never be the latest."""
    joined = both.join(bounds, list(keys), "left")
    joined = joined.withColumn("own_slab", F.when(F.col("known").isNull(), 0).otherwise(slab_of("bounds", "known", "tie")))
    ends = F.coalesce("until", F.lit(OPEN))
    facts = joined.where((F.col("side") == 0) & F.col("bounds").isNotNull())
    longest = (
        facts.where(F.col("valid") == F.col("known")).withColumn("ends", ends)
        .groupBy(*keys, "attribute", "own_slab").agg(F.max("ends").alias("most"))
        .groupBy(*keys, "attribute").agg(F.array_sort(F.collect_list(F.struct("own_slab", "most"))).alias("longest"))
    )
    facts = facts.join(longest, [*keys, "attribute"], "left")
    outlived = F.get(F.filter("longest", lambda x: (x["own_slab"] > F.col("own_slab")) & (x["most"] >= ends))["own_slab"], F.lit(0))
    last = F.coalesce(F.when(F.lit(same) & (F.col("valid") <= F.col("known")), outlived), F.size("bounds"))
    spread = facts.withColumn("slab_no", F.explode(F.sequence(F.col("own_slab"), last)))
    rest = joined.where((F.col("side") == 1) | F.col("bounds").isNull()).withColumn("slab_no", F.col("own_slab"))
    return rest.unionByName(spread.select(*rest.columns)).drop("bounds", "own_slab")

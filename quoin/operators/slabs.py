"""Slabs for hot keys.

A key with more than ``limit`` rows is cut along its (time, tie) order into slabs of about ``limit`` rows, so that no task holds an
unbounded group; rows of one time are cut by their tie breaker. All other keys keep one slab. The slab table has at most about
rows / limit bounds in all; it is joined without a hint, so Spark broadcasts it only when its measured size is below the
session's own threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes at most, roughly.
LIMIT = 500_000
LEAST = -(2**63)


def slab_bounds(df: DataFrame, keys: Sequence[str], time: str, tie: str, limit: int = LIMIT) -> DataFrame | None:
    """(keys, bounds): inner slab bounds, ascending structs of t and tie, of each key of more than ``limit`` rows; None if there is none.
    ``time`` and ``tie`` are longs, not null. Passes: partial counts by key; then quantiles of time of the hot keys alone; then, for
    times that fill whole slabs, quantiles of their ties."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    rows = hot.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most")).first()
    if not rows["keys"]:
        return None
    share = min(0.5, limit / rows["most"])
    steps = [share * i for i in range(1, int(1 / share) + 1) if share * i < 1]
    at = lambda c: F.percentile_approx(c, F.array(*map(F.lit, steps)), F.lit(max(10_000, 20 * len(steps))))
    own = df.join(hot.select(*keys), list(keys), "left_semi")
    times = own.groupBy(*keys).agg(at(time).alias("times"))
    cell = lambda t, i: F.struct(t.alias("t"), i.alias("tie"))
    plain = times.select(*keys, F.explode(F.array_distinct("times")).alias("t_")).select(*keys, cell(F.col("t_"), F.lit(LEAST)).alias("b"))
    full = F.filter(F.array_distinct("times"), lambda t: F.size(F.filter("times", lambda u: u == t)) > 1)
    crowded = times.select(*keys, F.explode(full).alias("t_"))
    ties = own.select(*keys, F.col(time).alias("t_"), F.col(tie).alias("i_")).join(crowded, [*keys, "t_"]).groupBy(*keys, "t_").agg(at("i_").alias("ties"))
    inner = ties.select(*keys, "t_", F.explode(F.array_distinct("ties")).alias("i_"))
    both = plain.unionByName(inner.select(*keys, cell(F.col("t_"), F.col("i_")).alias("b")))
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set("b")).alias("bounds"))


def slab_of(bounds: str, time: str | Column, tie: str | Column) -> Column:
    """Number of the slab that (time, tie) lies in: how many bounds are at or before it."""
    at = F.struct(_col(time).alias("t"), _col(tie).alias("tie"))
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= at)), F.lit(0))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunked(rows: DataFrame, many: Column, group: Sequence[str], mark: Column, limit: int) -> DataFrame:
    """``rows`` with chunk_no: of each group, the rows that are ``many`` are dealt by ``mark`` over as many chunks as keep about ``limit`` in
    each, and all other rows go to every one of these."""
    counts = rows.where(many).groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("chunks"))
    placed = rows.join(counts, list(group), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64(mark), F.col("chunks")).cast("int"))
    return placed.withColumn("chunk_no", F.explode(F.when(many, one).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("chunks")

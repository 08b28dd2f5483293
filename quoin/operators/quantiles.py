"""Exact quantiles without a sort of the whole column or a buffer of its values.

Four passes: values are counted; an approximate aggregate brackets each wanted rank within a few hundredths of a percent of the rows; counts say how many
values lie below each bracket; and only the brackets' values are sorted, each bracket by itself, to find the ranks. Every pass is one job
for all columns and quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the approximate pass: its ranks are off by one in this many rows at most.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of each column; nulls and NaN are left out, and a column without values has None. ``df`` is read four times, so a costly
    one should be materialised before. Repeated values count as often as they come."""
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles are fractions")
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)))
    if not columns or not at:
        return {c: [] for c in columns}
    n = values.agg(*(F.count(f"v{i}") for i in range(len(columns)))).first()
    probes = {i: [p for q in at for m in [2.0 / ACCURACY + 2.0 / n[i]] for p in (max(0.0, q - m), min(1.0, q + m))] for i in range(len(columns)) if n[i]}
    rough = values.agg(F.count(F.lit(1)), *(F.percentile_approx(f"v{i}", F.array(*map(F.lit, p)), F.lit(ACCURACY)).alias(f"p{i}") for i, p in probes.items())).first()
    cells = [(i, j, rough[f"p{i}"][2 * j], rough[f"p{i}"][2 * j + 1]) for i in probes for j in range(len(at))]
    if not cells:
        return dict.fromkeys(columns)
    under = values.agg(*(F.count_if(F.col(f"v{i}") < F.lit(low)).alias(f"b{i}_{j}") for i, j, low, _ in cells)).first()
    inside = F.array_compact(F.array(*(F.when(F.col(f"v{i}").between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("v"))) for i, j, low, high in cells)))
    counts = values.select(F.explode(inside).alias("c")).select("c.*").groupBy("i", "j", "v").count()
    upto = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("i", "j").orderBy("v")))
    wanted = {}  # (i, j) -> ranks within the bracket, from 1
    for i, j, _, _ in cells:
        rank = at[j] * (n[i] - 1)
        wanted[i, j] = (floor(rank) + 1 - under[f"b{i}_{j}"], ceil(rank) + 1 - under[f"b{i}_{j}"], rank - floor(rank))
    hit = F.lit(False)
    for (i, j), (low, high, _) in wanted.items():
        holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("count") < r)
        hit = hit | ((F.col("i") == i) & (F.col("j") == j) & (holds(low) | holds(high)))
    found: dict[tuple[int, int], list] = {}
    for r in upto.where(hit).collect():  # two values a quantile at most
        found.setdefault((r["i"], r["j"]), []).append((r["upto"], r["v"]))
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        if not n[i]:
            out[c] = None
            continue
        out[c] = []
        for j in range(len(at)):
            low, high, part = wanted[i, j]
            own = sorted(found[i, j])
            pick = lambda r: next(v for upto_, v in own if upto_ >= r)
            out[c].append(pick(low) + (pick(high) - pick(low)) * part)
    return out

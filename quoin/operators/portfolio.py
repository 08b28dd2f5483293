"""Weights under constraints, fills and scenario backtests. Dates run beside each other; a backtest is sequential in time, so its dates, each
reduced to arrays of its names, stream through one task per group of scenarios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import div
from quoin.operators.evaluate import equity_curve, sharpe
from quoin.operators.runs import co_sorted


def long_short(scores: DataFrame, score: str, share: float) -> DataFrame:
    """side (1, -1 or 0): the ceil(n x share) best and worst of each date, ties by security; in tiny cross-sections the best win."""
    day = Window.partitionBy("date")
    ok = F.col(score).isNotNull()
    n = F.ceil(F.count(score).over(day) * share)
    up = F.row_number().over(day.orderBy(F.col(score).desc_nulls_last(), "security_id"))
    down = F.row_number().over(day.orderBy(F.col(score).asc_nulls_last(), "security_id"))
    return scores.withColumn("side", F.when(ok & (up <= n), 1).when(ok & (down <= n), -1).otherwise(0))


def project(raw: np.ndarray, equalities: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60, tolerance: float = 1e-10) -> np.ndarray:
    """Nearest point to ``raw`` with equalities @ w = values and low <= w <= high, by Newton steps on the dual: at its multipliers the
    solution is ``raw`` shifted along the equalities and clipped. Where nothing is feasible, the point that comes nearest within ``rounds``."""
    dual = np.zeros(len(values))
    at = lambda d: np.clip(raw + equalities.T @ d, low, high)
    w = at(dual)
    gap = values - equalities @ w
    for _ in range(rounds):
        if np.abs(gap).max() < tolerance:
            break
        free = equalities[:, (w > low) & (w < high)]
        step = np.linalg.lstsq(free @ free.T + 1e-12 * np.eye(len(values)), gap, rcond=None)[0]
        for shrink in (1.0, 0.5, 0.25, 0.1, 0.03):
            new = at(dual + shrink * step)
            left = values - equalities @ new
            if np.linalg.norm(left) < np.linalg.norm(gap) * (1 - 1e-3 * shrink):
                break
        else:  # no step brings it nearer: nothing is feasible
            break
        dual, w, gap = dual + shrink * step, new, left
    return w


def constrained_weights(sides: DataFrame, *, gross: float = 1.0, net: float = 0.0, name_cap: float = 0.1) -> DataFrame:
    """weight per date and security with a side: the sides' grosses are (gross +- net) / 2, beta and every sector's net are zero where
    that is feasible, and no weight is beyond ``name_cap``. Null betas count as zero; rows without a side get no weight."""
    if abs(net) > gross:
        raise ValueError("net beyond gross")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy(dtype=float)
        ups, downs = side > 0, side < 0
        n_up, n_down = max(1, ups.sum()), max(1, downs.sum())
        raw = np.where(ups, (gross + net) / 2 / n_up, -(gross - net) / 2 / n_down)
        lines, values = [ups.astype(float), downs.astype(float)], [(gross + net) / 2 * ups.any(), -(gross - net) / 2 * downs.any()]
        soft = [rows["beta_estimate"].fillna(0.0).to_numpy(dtype=float)] + [(rows["sector"] == s).to_numpy(dtype=float) for s in rows["sector"].dropna().unique()]
        low, high = np.where(ups, 0.0, -name_cap), np.where(ups, name_cap, 0.0)
        w = project(raw, np.array(lines + soft), np.array(values + [0.0] * len(soft)), low, high)
        if np.abs(np.array(lines) @ w - np.array(values)).max() > 1e-6:  # neutrality is not feasible: keep grosses and caps
            w = project(raw, np.array(lines), np.array(values), low, high)
        return pd.DataFrame({"date": rows["date"], "security_id": rows["security_id"], "weight": w})

    chosen = sides.where("side <> 0").select("date", "security_id", "side", "beta_estimate", "sector")
    return chosen.groupBy("date").applyInPandas(solve, "date date, security_id string, weight double")


def trades(target: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """target, held and trade per ``keys``: full outer, missing weights zero."""
    both = target.join(held, list(keys), "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("target", "held")})
    return both.withColumn("trade", F.col("target") - F.col("held"))


def fill_ratio(weight: str | Column, aum: str | Column, capacity: str | Column, most: float) -> Column:
    """Share of a trade that fits in ``most`` of the day's capacity; zero without capacity, one without a trade."""
    size = F.abs(weight) * (F.col(aum) if isinstance(aum, str) else aum)
    room = F.coalesce(F.col(capacity) if isinstance(capacity, str) else capacity, F.lit(0.0)) * most
    return F.when(size <= 0, 1.0).otherwise(F.least(F.lit(1.0), div(room, size)))


def impact(participation: str | Column, base: float, root: float) -> Column:
    """Base plus square-root cost, in the units of its parameters."""
    p = F.greatest(F.coalesce(F.col(participation) if isinstance(participation, str) else participation, F.lit(0.0)), F.lit(0.0))
    return base + root * F.sqrt(p)


#: Scenarios that share a task, as rows of the same arrays.
TOGETHER = 6
_STATE = "scenario string, date date, aum double, gross_pnl double, cost double, net_pnl double, turnover double, clipped double"


def backtest(days: DataFrame, scenarios: DataFrame, *, start_aum: float = 1e6) -> DataFrame:
    """State per scenario and date: aum, gross_pnl, cost, net_pnl, turnover and clipped (share of trades not fully filled).

    ``days``: date, security_id, weight (the target), day_return (null as 0) and capacity. ``scenarios``: scenario, participation, cost_rate and
    aum_multiple; names of scenarios are unique. AUM depends on fills, which depend on AUM, so a scenario is one scan in time. Each date is reduced to one
    row of arrays first; groups of ``TOGETHER`` scenarios each scan these rows as a stream and hold the last date's weights alone. A security held but
    absent from a date is sold that day. The scenarios are held on the driver.
    """
    rows = scenarios.select("scenario", "participation", "cost_rate", "aum_multiple").orderBy("scenario").collect()
    if not rows:
        return days.sparkSession.createDataFrame([], _STATE)
    cell = F.struct("security_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("day_return", F.lit(0.0)).alias("r"), F.coalesce("capacity", F.lit(0.0)).alias("capacity"))
    one = days.groupBy("date").agg(F.array_sort(F.collect_list(cell)).alias("names"))  # a date's cross-section
    flat = one.select("date", *(F.col(f"names.{c}").alias(c) for c in ("security_id", "weight", "r", "capacity")))
    groups = -(-len(rows) // TOGETHER)
    placed = flat.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return co_sorted(placed, ["group"], ["date"]).mapInArrow(_scan([tuple(r) for r in rows], start_aum), _STATE)


def _scan(rows: list[tuple], start_aum: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            out = []
            for date, names, weight, change, capacity, own in zip(*(batch.column(c).to_pylist() for c in ("date", "security_id", "weight", "r", "capacity", "group"))):
                if own != group:
                    group, mine = own, rows[own * TOGETHER : (own + 1) * TOGETHER]
                    most, rate, aum = (np.array([r[i] for r in mine], dtype=float) for i in (1, 2, 3))
                    aum, place, held = aum * start_aum, {}, np.zeros((len(mine), 0))
                names_at = np.array([place.get(n, -1) for n in names])
                there = names_at >= 0
                before = np.zeros((len(mine), len(names)))
                before[:, there] = held[:, names_at[there]]
                closed = np.abs(held).sum(axis=1) - np.abs(before).sum(axis=1)
                wanted = (np.array(weight) - before) * aum[:, None]
                done = np.sign(wanted) * np.minimum(np.abs(wanted), np.array(capacity) * most[:, None])
                alive = aum > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    now = np.where(alive[:, None], before + done / aum[:, None], 0.0)
                gross = (now * aum[:, None] * np.array(change)).sum(axis=1)
                traded = np.abs(done).sum(axis=1) + closed * np.maximum(aum, 0.0)
                cost = traded * rate
                clipped = (np.abs(done) < np.abs(wanted) * 0.999999).mean(axis=1)
                turnover = np.divide(traded, aum, out=np.zeros(len(mine)), where=alive)
                aum = aum + gross - cost
                place, held = {n: i for i, n in enumerate(names)}, now
                out += [(r[0], date, *map(float, v)) for r, *v in zip(mine, aum, gross, cost, gross - cost, turnover, clipped)]
            if out:
                schema = pa.schema([("scenario", pa.string()), ("date", pa.date32()), *((c, pa.float64()) for c in ("aum", "gross_pnl", "cost", "net_pnl", "turnover", "clipped"))])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return task


def capacity_table(state: DataFrame) -> DataFrame:
    """Per scenario: days, final AUM, net Sharpe ratio, mean turnover, 95th percentile and mean of clipped shares."""
    own = state.withColumn("r_", F.try_divide("net_pnl", F.col("aum") - F.col("net_pnl")))
    return own.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("days"), F.max_by("aum", "date").alias("final_aum"), sharpe("r_").alias("net_sharpe"), F.avg("turnover").alias("mean_turnover"),
        F.percentile("clipped", 0.95).alias("p95_clipped"), F.avg("clipped").alias("mean_clipped"),
    )


def cost_table(state: DataFrame) -> DataFrame:
    """Per scenario: net Sharpe ratio, deepest drawdown and final AUM."""
    curve = equity_curve(state.withColumn("r_", F.try_divide("net_pnl", F.col("aum") - F.col("net_pnl"))), "r_", "scenario")
    return curve.groupBy("scenario").agg(sharpe("r_").alias("net_sharpe"), F.min("drawdown").alias("max_drawdown"), F.max_by("aum", "date").alias("final_aum"))


def portfolio_inputs(predictions: DataFrame, universe: DataFrame, features: DataFrame, model: str | None = None) -> DataFrame:
    """Predictions of one model with what ``universe`` and ``features`` (one row a date and security each) know of their rows: columns that both have come
    from the first that is not null. Several models without a name raise. All dates at once."""
    rows = predictions if model is None else predictions.where(F.col("model_name") == model)
    if model is None and "model_name" in predictions.columns and rows.agg(F.count_distinct("model_name")).first()[0] > 1:
        raise ValueError("several models; name one")
    keys = ["date", "security_id"]
    out = rows
    for other in (universe, features):
        shared = [c for c in other.columns if c in out.columns and c not in keys]
        joined = out.join(other.select(*keys, *(F.col(c).alias(f"{c}__o" if c in shared else c) for c in other.columns if c not in keys)), keys, "left")
        out = joined.withColumns({c: F.coalesce(c, f"{c}__o") for c in shared}).drop(*(f"{c}__o" for c in shared)) if shared else joined
    return out


def water_fill(names: np.ndarray, groups: Sequence, sign: int, gross: float, name_cap: float, gross_cap: float, net_cap: float, used: dict, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refused) of one side: rounds give every open name the same share of what is left, as far as its own cap and its group's gross and net
    allow, in order; a name at a cap leaves, and rounds end when all is given or nothing moves. ``used`` and ``net`` are the groups' totals."""
    weight, refused = np.zeros(len(names)), np.zeros(len(names), dtype=bool)
    left, open_ = gross, list(range(len(names)))
    equal = gross / max(1, len(names))
    while left > 1e-12 and open_:
        share, moved, still = min(equal, left / len(open_)), False, []
        for i in open_:
            g = groups[i]
            room = lambda: min(name_cap - weight[i], gross_cap - used.get(g, 0.0), net_cap - sign * net.get(g, 0.0))  # noqa: B023, E731
            give = min(share, room(), left)
            if give <= 1e-12:
                refused[i] = True
                continue
            weight[i] += give
            used[g], net[g], left, moved = used.get(g, 0.0) + give, net.get(g, 0.0) + sign * give, left - give, True
            if room() > 1e-12:
                still.append(i)
        if not moved:
            break
        open_ = still
    return sign * weight, refused


def capped_weights(sides: DataFrame, *, gross: float = 1.0, net: float = 0.0, name_cap: float = 0.1, group_gross: float = 1.0, group_net: float = 1.0) -> DataFrame:
    """weight and refused (a cap left no room for more) per date and security with a side: each side's gross, (gross +- net) / 2, filled evenly under caps on names
    and on the gross and net of sectors, longs before shorts, best scores first. A null sector is a group of its own. One group a date."""
    if abs(net) > gross:
        raise ValueError("net beyond gross")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        used, nets, parts = {}, {}, []
        for sign, total in ((1, (gross + net) / 2), (-1, (gross - net) / 2)):
            own = rows[rows["side"] == sign].sort_values(["score", "security_id"], ascending=[sign < 0, True], kind="stable")
            weight, refused = water_fill(own["security_id"].to_numpy(), own["sector"].fillna("").tolist(), sign, total, name_cap, group_gross, group_net, used, nets)
            parts.append(pd.DataFrame({"date": own["date"], "security_id": own["security_id"], "weight": weight, "refused": refused}))
        return pd.concat(parts)

    return sides.where("side <> 0").select("date", "security_id", "side", "score", "sector").groupBy("date").applyInPandas(fill, "date date, security_id string, weight double, refused boolean")

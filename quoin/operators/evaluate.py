"""Predictive, portfolio and skepticism statistics. Sums run in Spark; closed forms over a handful of numbers run on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from math import e, exp, log, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import guarded_corr, normal_cdf, pct_rank, quantile_bucket

YEAR = 252
GAMMA = 0.5772156649015329  # Euler's constant


def daily_ic(scored: DataFrame, prediction: str, label: str, *by: str) -> DataFrame:
    """ic and rank_ic of every date (and ``by``): Pearson on values, and on average ranks within the date. Rows laid out by date stay there."""
    both = F.col(prediction).isNotNull() & F.col(label).isNotNull()
    ranks = {"rp_": pct_rank(prediction, "date", *by, mask=both), "rl_": pct_rank(label, "date", *by, mask=both)}
    return scored.withColumns(ranks).groupBy("date", *by).agg(guarded_corr(prediction, label).alias("ic"), guarded_corr("rp_", "rl_").alias("rank_ic"), F.count_if(both).alias("pairs"))


def unpivoted(panel: DataFrame, scores: Sequence[str], keep: Sequence[str], name: str = "hypothesis", value: str = "prediction") -> DataFrame:
    """One row per row of ``panel`` and score: ``keep``, the score's name and its value. Rows stay where they lie."""
    cells = F.array(*(F.struct(F.lit(s).alias(name), F.col(s).cast("double").alias(value)) for s in scores))
    return panel.select(*keep, F.explode(cells).alias("c_")).select(*keep, f"c_.{name}", f"c_.{value}")


def rolling_ic(daily: DataFrame, days: int = 21, least: int = 3) -> DataFrame:
    """rolling_rank_ic: mean rank_ic over the last ``days`` dates, null under ``least`` values. One row a date."""
    frame = Window.orderBy("date").rowsBetween(1 - days, 0)
    return daily.withColumn("rolling_rank_ic", F.when(F.count("rank_ic").over(frame) >= least, F.avg("rank_ic").over(frame)))


def decay_ends(curve: DataFrame) -> DataFrame:
    """Mean label of the lowest and of the highest bucket per horizon of ``decay``."""
    return curve.groupBy("horizon").agg(F.min_by("mean_label", "bucket").alias("bottom"), F.max_by("mean_label", "bucket").alias("top"))


def wide_predictions(predictions: DataFrame, models: Sequence[str], model: str = "model_name", value: str = "raw_prediction") -> DataFrame:
    """One row per date and security, one column per model: its first prediction (the least, if there are several)."""
    return predictions.groupBy("date", "security_id").agg(*(F.min(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models))


def hypotheses(daily: DataFrame, *by: str) -> DataFrame:
    """Per hypothesis (``by``): rank_ic_mean, its days, and p, that of a mean this high or higher if the true one were zero; null under two days or
    without variation."""
    n, mean, sd = F.count("rank_ic"), F.avg("rank_ic"), F.stddev_samp("rank_ic")
    one = daily.groupBy(*by).agg(mean.alias("rank_ic_mean"), n.alias("days"), F.when((n >= 2) & (sd > 1e-12), mean / (sd / F.sqrt(n.cast("double")))).alias("t_"))
    return one.withColumn("p", 1.0 - normal_cdf("t_")).drop("t_")


def regimes(benchmark: DataFrame, lookback: int = 63) -> DataFrame:
    """risk_on or risk_off per date, by the sign of the benchmark's return over ``lookback`` sessions; risk_on before there is one."""
    order = Window.orderBy("trade_date")  # one row a day
    change = F.coalesce(F.try_divide("close", F.lag("close", lookback).over(order)) - 1, F.lit(0.0))
    return benchmark.select(F.col("trade_date").alias("date"), F.when(change >= 0, "risk_on").otherwise("risk_off").alias("regime"))


def decay(scored: DataFrame, prediction: str, labels: dict[int, str], buckets: int = 5) -> DataFrame:
    """Mean label per horizon and prediction bucket of its date."""
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("label")) for h, c in labels.items()))
    rows = scored.withColumn("bucket", quantile_bucket(prediction, buckets, "date")).where("bucket IS NOT NULL")
    return rows.select("bucket", F.explode(cells).alias("c")).groupBy("c.horizon", "bucket").agg(F.avg("c.label").alias("mean_label"), F.count("c.label").alias("rows"))


def sharpe(r: str) -> Column:
    return F.when((F.count(r) >= 2) & (F.stddev_pop(r) > 1e-15), F.avg(r) / F.stddev_pop(r) * sqrt(YEAR))


def equity_curve(returns: DataFrame, r: str, *by: str) -> DataFrame:
    """equity, peak and drawdown along the dates; a return of -1 or less ends in ruin, equity zero. One row a date and scenario."""
    order = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.max((F.col(r) <= -1).cast("int")).over(order) > 0
    grown = F.exp(F.sum(F.when(F.col(r) > -1, F.log1p(r))).over(order))
    out = returns.withColumn("equity", F.when(ruined, 0.0).otherwise(F.coalesce(grown, F.lit(1.0))))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(order)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def aum_returns(state: DataFrame, *by: str) -> DataFrame:
    """period_return: net_pnl over the AUM before it."""
    before = F.coalesce(F.lag("aum").over(Window.partitionBy(*by).orderBy("date")), F.col("aum") - F.col("net_pnl"))
    return state.withColumn("period_return", F.try_divide("net_pnl", before))


def correlation_matrix(predictions: DataFrame, model: str = "model_name", value: str = "raw_prediction") -> DataFrame:
    """Correlation of every pair of models over the rows both predict, from one pass: the models of a row come together in a map, then
    pairs of models (not of rows) are summed."""
    row = predictions.groupBy("date", "security_id").agg(F.map_from_entries(F.collect_list(F.struct(model, value))).alias("m"))
    left = row.select("m", F.explode("m").alias("model_a", "a"))
    pairs = left.select("model_a", "a", F.explode("m").alias("model_b", "b"))
    return pairs.groupBy("model_a", "model_b").agg(guarded_corr("a", "b").alias("correlation"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("rows"))


def fdr(pvalues: DataFrame, family: str, p: str, q: float) -> DataFrame:
    """rank, threshold and rejected of each hypothesis: pointwise p <= rank / m x q within its family; a null p is never rejected."""
    order = Window.partitionBy(family).orderBy(F.col(p).asc_nulls_last(), "hypothesis")
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    out = pvalues.withColumns({"rank": F.row_number().over(order), "threshold": F.row_number().over(order) / m * q})
    return out.withColumn("rejected", F.coalesce(F.col(p) <= F.col("threshold"), F.lit(False)))


def moments(returns: DataFrame, r: str, *by: str) -> DataFrame:
    """n, mean, std, skew (0) and kurtosis (3, not excess), with the values in parentheses where there is no variation or too little data."""
    n, sd = F.count(r), F.stddev_pop(r)
    return returns.groupBy(*by).agg(
        n.alias("n"), F.avg(r).alias("mean"), sd.alias("std"), F.when((n >= 3) & (sd > 1e-12), F.skewness(r)).otherwise(0.0).alias("skew"),
        F.when((n >= 4) & (sd > 1e-12), F.kurtosis(r) + 3.0).otherwise(3.0).alias("kurtosis"),
    )


def one_sided_p(mean: float, std_sample: float, n: int) -> float | None:
    """P of a mean this high, or higher, if the true mean were zero."""
    if n < 2 or std_sample <= 1e-12:
        return None
    return 1.0 - NormalDist().cdf(mean / (std_sample / sqrt(n)))


def probabilistic_sharpe(ratio: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float | None:
    variance = 1 - skew * ratio + (kurtosis - 1) / 4 * ratio**2
    if n < 2 or variance <= 0:
        return None
    return NormalDist().cdf((ratio - benchmark) * sqrt(n - 1) / sqrt(variance))


def deflated_sharpe(ratio: float, n: int, skew: float, kurtosis: float, trials: int, spread: float | None = None) -> float | None:
    """Against the ratio that the best of ``trials`` without skill would reach, given the spread of their ratios: by default the standard error of this
    one, from its length, skew and kurtosis."""
    if trials < 2:
        return probabilistic_sharpe(ratio, n, skew, kurtosis)
    if spread is None:
        variance = 1 - skew * ratio + (kurtosis - 1) / 4 * ratio**2
        if n < 2 or variance <= 0:
            return None
        spread = sqrt(variance / (n - 1))
    z = NormalDist().inv_cdf
    expected = spread * ((1 - GAMMA) * z(1 - 1 / trials) + GAMMA * z(1 - 1 / (trials * e)))
    return probabilistic_sharpe(ratio, n, skew, kurtosis, expected)


def block_bootstrap(values: Sequence[float], statistic, draws: int = 300, block: int = 20, seed: int = 0) -> np.ndarray:
    """``statistic`` of circular block resamples of a daily series."""
    x = np.asarray(values, dtype=float)
    if not len(x):
        return np.zeros(0)
    rng = np.random.default_rng(seed)
    block = max(1, min(block, len(x)))
    starts = rng.integers(0, len(x), size=(draws, -(-len(x) // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, : len(x)] % len(x)
    return np.array([statistic(row) for row in x[at]])


def interval(draws: np.ndarray, level: float = 0.95) -> tuple[float | None, float | None]:
    """The middle ``level`` of the draws that are numbers."""
    draws = draws[np.isfinite(draws)]
    return (None, None) if not len(draws) else tuple(float(q) for q in np.quantile(draws, [(1 - level) / 2, (1 + level) / 2]))


def predictive_uncertainty(rank_ic: Sequence[float], ic: Sequence[float], *, draws: int = 300, block: int = 20, seed: int = 42) -> dict[str, float | None]:
    """Means of daily ICs with block-bootstrap intervals, the share of positive days, and the one-sided p of the rank IC. The series have one
    number a session and are held on the driver; None and NaN are left out."""
    out: dict[str, float | None] = {}
    clean = {"rank_ic": _numbers(rank_ic), "ic": _numbers(ic)}
    for i, (name, x) in enumerate(clean.items()):
        out[f"{name}_mean"] = float(x.mean()) if len(x) else None
        out[f"{name}_ci_lower"], out[f"{name}_ci_upper"] = interval(block_bootstrap(x, np.mean, draws, block, seed + i))
    x = clean["rank_ic"]
    out["rank_ic_positive_fraction"] = float((x > 0).mean()) if len(x) else None
    out["rank_ic_p_value"] = one_sided_p(float(x.mean()), float(x.std(ddof=1)), len(x)) if len(x) > 1 else None
    return out | {"sample_size_days": float(len(x))}


def _numbers(values: Sequence[float]) -> np.ndarray:
    x = np.array([np.nan if v is None else v for v in values], dtype=float)
    return x[np.isfinite(x)]


def _sharpe(x: np.ndarray) -> float:
    spread = x.std()
    return float(x.mean() / spread * sqrt(YEAR)) if spread > 1e-12 else float("nan")


def portfolio_uncertainty(returns: Sequence[float], trials: int = 1, *, draws: int = 300, block: int = 20, seed: int = 42) -> dict[str, float | None]:
    """Sharpe ratio with a block-bootstrap interval, probabilistic and deflated ratios, skew (0) and kurtosis (3) of daily net returns. One number a
    session, held on the driver."""
    x = _numbers(returns)
    if not len(x):
        return {}
    ratio, spread = _sharpe(x), float(x.std())
    skew = float((((x - x.mean()) / spread) ** 3).mean()) if len(x) > 2 and spread > 1e-12 else 0.0
    kurtosis = float((((x - x.mean()) / spread) ** 4).mean()) if len(x) > 3 and spread > 1e-12 else 3.0
    low, high = interval(block_bootstrap(x, _sharpe, draws, block, seed))
    flat = ratio != ratio
    return {
        "net_sharpe": None if flat else ratio, "net_sharpe_ci_lower": low, "net_sharpe_ci_upper": high,
        "probabilistic_sharpe_ratio": float(x.mean() > 0) if flat else probabilistic_sharpe(ratio, len(x), skew, kurtosis),
        "deflated_sharpe_ratio": float(x.mean() > 0) if flat else deflated_sharpe(ratio, len(x), skew, kurtosis, max(1, trials)),
        "effective_trial_count": float(max(1, trials)), "return_skewness": skew, "return_kurtosis": kurtosis, "sample_size_days": float(len(x)),
    }


#: Gate -> side and bound of what is observed: fixed values. Stressed costs are held against half of the base case's Sharpe ratio, at most zero.
GATES = {
    "predictive_floor": (">=", -0.01), "deflated_sharpe": (">=", 0.5), "regime_balance": (">=", -0.10), "ablation_resilience": (">=", -0.05),
    "position_concentration": ("<=", 0.25), "capacity_clip": ("<=", 0.25),
}


def stability_gates(observed: dict[str, float | None], base_sharpe: float | None, stressed_sharpe: float | None) -> list[dict]:
    """The seven gates as rows: gate, passed, observed, threshold. What is missing passes."""
    limits = GATES | ({} if base_sharpe is None or base_sharpe != base_sharpe else {"cost_robustness": (">=", min(0.0, 0.5 * base_sharpe))})
    values = dict(observed) | {"cost_robustness": stressed_sharpe}
    passed = gates(values, limits)
    return [{"gate": g, "passed": passed.get(g, True), "observed": values.get(g), "threshold": limits.get(g, (None, None))[1]} for g in (*GATES, "cost_robustness")]


def gates(observed: dict[str, float | None], limits: dict[str, tuple[str, float]]) -> dict[str, bool]:
    """Whether each observed value keeps its limit, (">=" or "<=", bound); a missing or NaN value passes."""
    def passes(name: str) -> bool:
        value, (kind, bound) = observed.get(name), limits[name]
        return value is None or value != value or (value >= bound if kind == ">=" else value <= bound)

    return {name: passes(name) for name in limits}


def fold_stability(fold_metrics: DataFrame) -> DataFrame:
    return fold_metrics.groupBy("model_name").agg(F.count(F.lit(1)).alias("folds"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_pop("rank_ic").alias("std_rank_ic"), F.avg("rows").alias("mean_rows"))


def sensitivity(trials: DataFrame) -> DataFrame:
    """Per model: trials, best and median score, their gap and that of the two best."""
    ranked = F.sort_array(F.collect_list("score"), asc=False)
    one = trials.groupBy("model_name").agg(F.count("score").alias("trials"), F.max("score").alias("best"), F.median("score").alias("median"), ranked.alias("s"))
    return one.select("model_name", "trials", "best", "median", (F.col("best") - F.col("median")).alias("best_less_median"), (F.get("s", F.lit(0)) - F.get("s", F.lit(1))).alias("top_two_gap"))


def deltas(results: DataFrame, group: str, scenario: str, metric: str) -> DataFrame:
    """Each scenario's metric less that of the first of its group."""
    first = F.first(metric).over(Window.partitionBy(group).orderBy(scenario).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return results.withColumn(f"{metric}_delta", F.col(metric) - first)


def drawdown_of(returns: Sequence[float]) -> float:
    """Deepest drawdown of a short series, on the driver."""
    level = peak = 1.0
    worst = 0.0
    for r in returns:
        level *= exp(log(1 + r)) if r > -1 else 0.0
        peak = max(peak, level)
        worst = min(worst, level / peak - 1)
    return worst

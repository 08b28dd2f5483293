"""The 92 registered panel features, as column expressions in three stages: windows by security, point-in-time fundamentals, ranks by date.

Rows move twice in all: by security for the first two stages, by date for the third. The windows by security share one order; each rank
sorts its date's rows by its own column. A query that asks for few features prunes the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from math import log as ln

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import by_date, col, div, lag, log, pct_rank, roll

RETURNS, MOMENTA, REVERSALS, RELATIVE = (1, 2, 3, 5, 10, 21, 63, 126, 252), (5, 10, 21, 63, 126, 252), (1, 2, 5), (5, 21, 63)
YEAR = 252
METRICS = (
    "book_equity", "net_income_ttm", "revenue_ttm", "operating_cashflow_ttm", "gross_profit_ttm", "operating_income_ttm", "total_assets", "total_debt",
    "ebit_ttm", "interest_expense_ttm", "current_assets", "current_liabilities", "shares_outstanding",
)
RANKED, SECTOR_RANKED = ("ret_5", "ret_21", "ret_63", "vol_21", "adv20"), ("ret_21", "vol_21", "adv20")
#: name -> factors, in registry order.
INTERACTIONS = {f"{a}_x_{b}": (a, b) for a, b in (("mom_21_ex1", "liquidity_rank_20"), ("rev_1", "vol_21"), ("book_to_price", "roe"), ("px_to_ma50", "vol_21"), ("earnings_yield", "liquidity_rank_20"))}

FAMILIES: dict[str, list[str]] = {
    "returns": [*(f"ret_{k}" for k in RETURNS), *(f"mom_{k}_ex1" for k in MOMENTA), *(f"rev_{k}" for k in REVERSALS)],
    "relative": [*(f"ex_bench_{k}" for k in RELATIVE), *(f"ex_sector_{k}" for k in RELATIVE)],
    "volatility": ["vol_5", "vol_10", "vol_21", "vol_63", "down_vol_21", "down_vol_63", "up_vol_21", "up_vol_63", "hl_range_21", "parkinson_21", "gk_21", "atr_14"],
    "liquidity": ["log_volume_1", "log_dollar_volume_1", "adv5", "adv20", "adv60", "volume_surprise_5", "volume_surprise_20", "amihud_21", "turnover_proxy_21", "zero_volume_rate_21", "liquidity_rank_20"],
    "trend": ["px_to_ma20", "px_to_ma50", "px_to_ma100", "px_to_ma200", "ma20_to_ma50", "ma50_to_ma200", "dist_to_20d_high", "dist_to_52w_high", "dist_to_20d_low", "dist_to_52w_low", "breakout_20d_up", "breakout_20d_down"],
    "xs_rank": [f"cs_rank_{c}" for c in RANKED],
    "sector_rank": [f"sector_rank_{c}" for c in SECTOR_RANKED],
    "fundamentals": ["book_to_price", "earnings_yield", "sales_yield", "cashflow_yield", "roe", "roa", "gross_profitability", "operating_margin", "accruals", "sales_growth_yoy", "earnings_growth_yoy", "asset_growth_yoy", "debt_to_equity", "interest_coverage", "current_ratio"],
    "staleness": ["days_since_last_filing", "fundamental_staleness_90", "fundamental_staleness_180", "missing_book_to_price_flag", "missing_quality_flag"],
    "interactions": list(INTERACTIONS),
}
REGISTERED = [f for names in FAMILIES.values() for f in names]


#: Named sets of features: every registered one, all but interactions, and what prices and volumes alone give.
FEATURE_SETS = {
    "all": REGISTERED, "no_interactions": [f for n, names in FAMILIES.items() if n != "interactions" for f in names],
    "technical": [f for n in ("returns", "relative", "volatility", "liquidity", "trend", "xs_rank", "sector_rank") for f in FAMILIES[n]],
}
#: Columns that are no features, whatever their names.
AUXILIARY = ("label_", "source_available_from__", "staleness_days__")


def feature_columns(panel: DataFrame, named: str = "all", also: Sequence[str] = ()) -> list[str]:
    """Columns of ``panel`` that belong to a feature set, in registry order, then those ``also`` asked for that are there and not auxiliary."""
    own = [f for f in FEATURE_SETS[named] if f in panel.columns]
    return own + [c for c in also if c in panel.columns and c not in own and not c.startswith(AUXILIARY)]


def silver_rows(rows: DataFrame) -> DataFrame:
    """Market rows with dollar_volume (close x volume where it is null or missing) and the quality flags, true where missing, and a score of one."""
    own = rows if "dollar_volume" in rows.columns else rows.withColumn("dollar_volume", F.lit(None).cast("double"))
    out = own.withColumn("dollar_volume", F.coalesce("dollar_volume", F.col("close") * F.col("volume")))
    defaults = {"is_price_valid": F.lit(True), "is_volume_valid": F.lit(True), "tradable_flag_prelim": F.lit(True), "data_quality_score": F.lit(1.0)}
    return out.withColumns({c: F.coalesce(c, d) if c in out.columns else d for c, d in defaults.items()})


Lazy = dict[str, Callable[[], Column]]


def price_features() -> Lazy:
    """Features of one security's own rows: date, open, high, low, close, volume, dollar_volume. Made when asked for."""
    high, low, close, volume = (lambda c=c: F.col(c) for c in ("high", "low", "close", "volume"))
    before = lambda: lag("close", 1)
    change = lambda k: div("close", lag("close", k)) - 1
    out: Lazy = {f"ret_{k}": lambda k=k: change(k) for k in RETURNS}
    out |= {f"mom_{k}_ex1": lambda k=k: div(before(), lag("close", k + 1)) - 1 for k in MOMENTA}
    out |= {f"rev_{k}": lambda k=k: -change(k) for k in REVERSALS}
    out["lr"] = lambda: log(div(close(), before()))
    out["true_range"] = lambda: F.greatest(high() - low(), F.abs(high() - before()), F.abs(low() - before()))
    out["traded"] = lambda: close() * volume()
    out["dollars"] = lambda: F.coalesce("dollar_volume", close() * volume())
    out["log_volume_1"] = lambda: F.when(volume().isNotNull(), F.log1p(F.greatest(volume().cast("double"), F.lit(0.0))))
    out["log_dollar_volume_1"] = lambda: F.when(volume().isNotNull(), F.log1p(F.greatest(close() * volume(), F.lit(0.0))))
    return out


def rolling_features() -> Lazy:
    """Rolling windows over price_features. Made when asked for."""
    lr = lambda: F.col("lr")
    side = {"down": lambda: F.when(lr().isNotNull(), F.least(lr(), F.lit(0.0))), "up": lambda: F.when(lr().isNotNull(), F.greatest(lr(), F.lit(0.0)))}
    hl, co = lambda: log(div("high", "low")), lambda: log(div("close", "open"))
    mean = lambda k: roll(F.avg, "close", k)
    out: Lazy = {f"vol_{k}": lambda k=k: roll(F.stddev_pop, "lr", k) for k in (5, 10, 21, 63)}
    out |= {f"{n}_vol_{k}": lambda n=n, k=k: roll(F.stddev_pop, side[n](), k) for n in side for k in (21, 63)}
    out["hl_range_21"] = lambda: roll(F.avg, div(F.col("high") - F.col("low"), "close"), 21)
    out["parkinson_21"] = lambda: F.sqrt(roll(F.sum, hl() * hl(), 21) / (4.0 * 21 * ln(2)))

    def garman_klass() -> Column:
        variance = roll(F.sum, 0.5 * hl() * hl() - (2 * ln(2) - 1) * co() * co(), 21) / 21.0
        return F.when(variance >= 0, F.sqrt(variance))

    out["gk_21"] = garman_klass
    out["atr_14"] = lambda: roll(F.avg, "true_range", 14)
    out |= {f"adv{k}": lambda k=k: roll(F.avg, "dollars", k) for k in (5, 20, 60)}
    out |= {f"volume_surprise_{k}": lambda k=k: div("volume", roll(F.avg, F.col("volume").cast("double"), k, skip=1)) for k in (5, 20)}
    out["amihud_21"] = lambda: roll(F.avg, F.when(F.col("traded") > 0, F.abs("ret_1") / F.col("traded")), 21)
    out["zero_volume_rate_21"] = lambda: roll(F.avg, (F.col("volume") == 0).cast("double"), 21)
    out |= {f"px_to_ma{k}": lambda k=k: div("close", mean(k)) - 1 for k in (20, 50, 100, 200)}
    out |= {f"ma{a}_to_ma{b}": lambda a=a, b=b: div(mean(a), mean(b)) - 1 for a, b in ((20, 50), (50, 200))}
    for k, name in ((20, "20d"), (YEAR, "52w")):
        out[f"dist_to_{name}_high"] = lambda k=k: div("close", roll(F.max, "high", k)) - 1
        out[f"dist_to_{name}_low"] = lambda k=k: div("close", roll(F.min, "low", k)) - 1
    out["breakout_20d_up"] = lambda: F.coalesce(F.col("close") > roll(F.max, "high", 20, skip=1), F.lit(False)).cast("long")
    out["breakout_20d_down"] = lambda: F.coalesce(F.col("close") < roll(F.min, "low", 20, skip=1), F.lit(False)).cast("long")
    return out


#: What rolling features are made from.
BASES = ("ret_1", "lr", "true_range", "traded", "dollars")


def beta(market_return: str, k: int = 63, least: int = 21) -> Column:
    """Rolling regression slope of ret_1 on the market's return; each moment over its own non-null rows."""
    x, y = col("ret_1"), col(market_return)
    mean = lambda c: roll(F.avg, c, k, least=least)
    spread = mean(y * y) - mean(y) * mean(y)
    return F.when(F.abs(spread) > 1e-12, (mean(x * y) - mean(x) * mean(y)) / spread)


def fundamental_features() -> dict[str, Column]:
    """Ratios of the point-in-time metric columns; lags count rows of the security."""
    cap = F.col("close") * F.col("shares_outstanding")
    average = lambda m: F.coalesce((F.col(m) + lag(m, YEAR)) / 2.0, F.col(m))
    growth = lambda m: div(m, lag(m, YEAR)) - 1
    return {
        "book_to_price": div("book_equity", cap), "earnings_yield": div("net_income_ttm", cap), "sales_yield": div("revenue_ttm", cap),
        "cashflow_yield": div("operating_cashflow_ttm", cap), "roe": div("net_income_ttm", average("book_equity")), "roa": div("net_income_ttm", average("total_assets")),
        "gross_profitability": div("gross_profit_ttm", "total_assets"), "operating_margin": div("operating_income_ttm", "revenue_ttm"),
        "accruals": div(F.col("net_income_ttm") - F.col("operating_cashflow_ttm"), "total_assets"), "sales_growth_yoy": growth("revenue_ttm"),
        "earnings_growth_yoy": growth("net_income_ttm"), "asset_growth_yoy": growth("total_assets"), "debt_to_equity": div("total_debt", "book_equity"),
        "interest_coverage": div("ebit_ttm", "interest_expense_ttm"), "current_ratio": div("current_assets", "current_liabilities"),
        "turnover_proxy_21": roll(F.avg, div("volume", "shares_outstanding"), 21),
    }


def with_price_features(market: DataFrame, benchmark: DataFrame, wanted: Collection[str] | None = None) -> DataFrame:
    """``market`` (one row per security and date) with its price and rolling features, bench_ret_k and beta_estimate. The benchmark
    has one row per date; its lags are over that short series. ``wanted``: only these, and what they are made from, so that a plan that needs few
    is a small one."""
    asked = lambda name: wanted is None or name in wanted
    days = Window.orderBy("trade_date")  # one row a day
    bench = benchmark.select(F.col("trade_date").alias("date"), *((div("close", F.lag("close", k).over(days)) - 1).alias(f"bench_ret_{k}") for k in (1, *RELATIVE)))
    needed = {*BASES, *(f"ret_{k}" for k in RELATIVE if asked(f"ex_bench_{k}"))}
    base = market.withColumns({n: f() for n, f in price_features().items() if asked(n) or n in needed}).join(bench, "date", "left")
    rolling = {n: f() for n, f in rolling_features().items() if asked(n)} | ({"beta_estimate": beta("bench_ret_1")} if asked("beta_estimate") else {})
    staged = base.withColumns(rolling) if rolling else base
    relative = {f"ex_bench_{k}": F.col(f"ret_{k}") - F.col(f"bench_ret_{k}") for k in RELATIVE if asked(f"ex_bench_{k}")}
    return staged.withColumns(relative) if relative else staged


def with_membership(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """``panel``, laid out by date, with in_universe: whether ``universe`` (date, security_id, is_in_universe; repeats and contradictions count as in) has
    the row inside; null where it has none. Both go through one exchange by date, and a window stands in for the join."""
    marks = universe.select("date", "security_id", F.col("is_in_universe").alias("in_"), F.lit(False).alias("own_"))
    both = by_date(panel.withColumns({"in_": F.lit(None).cast("boolean"), "own_": F.lit(True)}).unionByName(marks, allowMissingColumns=True))
    return both.withColumn("in_universe", F.bool_or("in_").over(Window.partitionBy("date", "security_id"))).where("own_").drop("in_", "own_")


def with_ranks(panel: DataFrame) -> DataFrame:
    """Cross-sections by date, among rows with in_universe; sector medians over all rows, null sector a group of its own. ``panel`` should be laid
    out by date, as with_membership leaves it."""
    inside = F.coalesce("in_universe", F.lit(False))
    ranks = {f"cs_rank_{c}": pct_rank(c, "date", mask=inside) for c in RANKED} | {"liquidity_rank_20": pct_rank("adv20", "date", mask=inside)}
    ranks |= {f"sector_rank_{c}": pct_rank(c, "date", "sector", mask=inside) for c in SECTOR_RANKED}
    ranks |= {f"ex_sector_{k}": F.col(f"ret_{k}") - F.median(f"ret_{k}").over(Window.partitionBy("date", "sector")) for k in RELATIVE}
    return panel.withColumns(ranks)


def with_fundamentals(panel: DataFrame) -> DataFrame:
    """Ratios, staleness and missing flags. Needs the metric columns and days_since_last_filing."""
    out = panel.withColumns(fundamental_features())
    days = F.col("days_since_last_filing")
    return out.withColumns({
        "fundamental_staleness_90": (days > 90).cast("long"), "fundamental_staleness_180": (days > 180).cast("long"),
        "missing_book_to_price_flag": F.col("book_to_price").isNull().cast("long"),
        "missing_quality_flag": (F.col("roe").isNull() | F.col("roa").isNull() | F.col("gross_profitability").isNull()).cast("long"),
    })


def with_interactions(panel: DataFrame, cap: int = 25) -> DataFrame:
    names = list(INTERACTIONS)[: max(cap, 0)]
    out = panel.withColumns({n: F.col(INTERACTIONS[n][0]) * F.col(INTERACTIONS[n][1]) for n in names}) if names else panel
    present = [c for c in REGISTERED if c in out.columns]
    return out.withColumn("feature_coverage_ratio", sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0)) / float(len(present)))


def latest_filing(facts: DataFrame, known: str = "available_from") -> DataFrame:
    """Each fact twice, as itself and as one of a pseudo metric "any_filing" that never ends, for an as-of join to the last filing. One scan."""
    names = F.explode(F.array("metric_name", F.lit("any_filing"))).alias("name_")
    both = facts.select("security_id", "metric_name", "metric_value", known, "available_to", names)
    any_ = F.col("name_") == "any_filing"
    return both.select("security_id", F.col("name_").alias("metric_name"), F.when(any_, 1.0).otherwise(F.col("metric_value")).alias("metric_value"), known, F.when(~any_, F.col("available_to")).alias("available_to"))


__all__ = ["FAMILIES", "METRICS", "REGISTERED", "latest_filing", "with_fundamentals", "with_interactions", "with_membership", "with_price_features", "with_ranks"]

"""Feature queries, one per family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.expr import OFF_HALF, grid
from quoin.operators.features import (
    FAMILIES, METRICS, MOMENTA, RANKED, REGISTERED, RELATIVE, RETURNS, REVERSALS, SECTOR_RANKED, YEAR,
    latest_filing, with_fundamentals, with_interactions, with_membership, with_price_features, with_ranks,
)
from quoin.operators.pit import asof_metrics
from quoin.plans.base import BASE, benchmark, calendar, grid_sql, market, market_rows, sectors
from quoin.plans.facts import FACTS_SQL, metric_facts
from quoin.session import table

FLAGS = ("breakout_20d_up", "breakout_20d_down", "days_since_last_filing", *FAMILIES["staleness"])


#: Price features that cross-sections rank.
CROSSED = {*RANKED, *SECTOR_RANKED, *(f"ret_{k}" for k in RELATIVE), "adv20"}


def _ranked(rows: DataFrame, spark: SparkSession, sf_dir: str, wanted: set[str] | None = None) -> DataFrame:
    """``rows`` with price features (the ``wanted`` ones), sector and cross-sections."""
    panel = with_price_features(rows, benchmark(spark, sf_dir), wanted).join(sectors(spark, sf_dir), "security_id", "left")
    return with_ranks(with_membership(panel, table(spark, sf_dir, "universe_snapshot").select("date", "security_id", "is_in_universe")))


def pit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market rows with the metrics known at each session's close and the sessions since the last filing."""
    days = calendar(spark, sf_dir).select(F.col("session_date").alias("date"), F.col("close_utc").alias("as_of"), "session_no")
    rows = market_rows(spark, sf_dir).join(days, "date", "left")
    facts = metric_facts(spark, sf_dir, "metric_value", "available_from", "available_to").where("available_to IS NULL OR available_to > available_from")
    panel = asof_metrics(rows, latest_filing(facts), "security_id", "as_of", [*METRICS, "any_filing"], metric="metric_name", value="metric_value", known="available_from", until="available_to").distinct()
    # sessions from the filing's day to the row's: sessions up to the one less sessions before the other, less one
    numbers = calendar(spark, sf_dir).select(F.col("session_date").alias("s"), "session_no")
    following = F.coalesce(F.lead("s").over(Window.orderBy("s")), F.date_add("s", 1))
    spans = numbers.select("s", (F.col("session_no")).alias("n"), following.alias("next"))
    first = numbers.agg(F.min("s")).first()[0]
    filled = spans.select(F.explode(F.sequence("s", F.date_sub("next", 1))).alias("day"), "s", "n")
    # sessions strictly before the filing's day
    before = filled.select(F.col("day").alias("filed"), F.when(F.col("day") == F.col("s"), F.col("n") - 1).otherwise(F.col("n")).alias("sessions_before"))
    filed = F.col("source_available_from__any_filing").cast("date")
    panel = panel.withColumn("filed", filed).join(before, "filed", "left")
    known_before = F.when(F.col("filed") < F.lit(first), F.lit(0)).otherwise(F.col("sessions_before"))
    return panel.withColumn("days_since_last_filing", F.when(F.col("filed") == F.col("date"), F.lit(0)).otherwise(F.col("session_no") - known_before - 1).cast("long"))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 92 features, in stages on the same rows: the facts known, ratios and prices where a security's rows lie, then ranks by date."""
    return with_interactions(_ranked(with_fundamentals(pit_panel(spark, sf_dir)), spark, sf_dir))


def _places(name: str) -> dict:
    """Money is put on whole hundredths."""
    return {"places": 2, "half": OFF_HALF} if name.startswith("adv") else {}


def _out(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.select("security_id", "date", *((F.col(c) if c in FLAGS else grid(c, **_places(c))).alias(c) for c in names)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _price_family(name: str):
    names = [c for c in FAMILIES[name] if c not in ("turnover_proxy_21", "liquidity_rank_20") and not c.startswith("ex_sector")]
    return lambda spark, sf_dir: _out(with_price_features(market(spark, sf_dir), benchmark(spark, sf_dir), names), names)


def feat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by date and by date and sector, and sector-relative returns."""
    return _out(_ranked(market(spark, sf_dir), spark, sf_dir, CROSSED), SECTIONS)


def feat_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(with_fundamentals(pit_panel(spark, sf_dir)), [*FAMILIES["fundamentals"], *FAMILIES["staleness"], "turnover_proxy_21"])


def feat_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions and the share of the 92 registered features that a row has."""
    return _out(full_panel(spark, sf_dir), [*FAMILIES["interactions"], "feature_coverage_ratio"])


def feat_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(with_price_features(market(spark, sf_dir), benchmark(spark, sf_dir), {"beta_estimate"}), ["beta_estimate", *(f"bench_ret_{k}" for k in RELATIVE)])


SECTIONS = [*FAMILIES["xs_rank"], *FAMILIES["sector_rank"], "liquidity_rank_20", *(f"ex_sector_{k}" for k in RELATIVE)]
PRICE_FAMILIES = ("returns", "relative", "volatility", "liquidity", "trend")
QUERIES = {f"feat_{n}": _price_family(n) for n in PRICE_FAMILIES} | {
    "feat_sections": feat_sections, "feat_fundamentals": feat_fundamentals, "feat_interactions": feat_interactions, "feat_beta": feat_beta,
}

# --- DuckDB ---------------------------------------------------------------------------------------------------------
W = "PARTITION BY security_id ORDER BY date"


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({W})"


def _roll(f: str, x: str, k: int, least: int | None = None, skip: int = 0) -> str:
    w = f"({W} ROWS BETWEEN {k - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) OVER {w} >= {k if least is None else least} THEN {f}({x}) OVER {w} END"


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def _log(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


_LN2 = "ln(2::DOUBLE)"
_PRICE = (
    [f"{_div('close', _lag('close', k))} - 1 AS ret_{k}" for k in RETURNS]
    + [f"{_div(_lag('close', 1), _lag('close', k + 1))} - 1 AS mom_{k}_ex1" for k in MOMENTA]
    + [f"-({_div('close', _lag('close', k))} - 1) AS rev_{k}" for k in REVERSALS]
    + [
        f"{_log(_div('close', _lag('close', 1)))} AS lr", f"greatest(high - low, abs(high - {_lag('close', 1)}), abs(low - {_lag('close', 1)})) AS tr",
        "close * volume AS traded", "coalesce(dollar_volume, close * volume) AS dollars", f"{_log('high / low')} AS hl", f"{_log('close / open')} AS co",
        "CASE WHEN volume IS NOT NULL THEN ln(1 + greatest(volume::DOUBLE, 0)) END AS log_volume_1", "CASE WHEN volume IS NOT NULL THEN ln(1 + greatest(close * volume, 0)) END AS log_dollar_volume_1",
    ]
)


def _ma(k: int) -> str:
    return _roll("avg", "close", k)


_ROLLING = (
    [f"{_roll('stddev_pop', 'lr', k)} AS vol_{k}" for k in (5, 10, 21, 63)]
    + [f"{_roll('stddev_pop', f'CASE WHEN lr IS NOT NULL THEN {g}(lr, 0) END', k)} AS {n}_vol_{k}" for n, g in (("down", "least"), ("up", "greatest")) for k in (21, 63)]
    + [f"{_roll('avg', '(high - low) / close', 21)} AS hl_range_21", f"sqrt({_roll('sum', 'hl * hl', 21)} / (4.0 * 21 * {_LN2})) AS parkinson_21".replace("sqrt(CASE", "sqrt((CASE").replace("END /", "END) /"), f"{_roll('sum', f'0.5 * hl * hl - (2 * {_LN2} - 1) * co * co', 21)} AS gk_sum", f"{_roll('avg', 'tr', 14)} AS atr_14"]
    + [f"{_roll('avg', 'dollars', k)} AS adv{k}" for k in (5, 20, 60)]
    + [f"{_div('volume', _roll('avg', 'volume::DOUBLE', k, skip=1))} AS volume_surprise_{k}" for k in (5, 20)]
    + [f"{_roll('avg', 'CASE WHEN traded > 0 THEN abs(ret_1) / traded END', 21)} AS amihud_21", f"{_roll('avg', '(volume = 0)::INT::DOUBLE', 21)} AS zero_volume_rate_21"]
    + [f"{_div('close', _ma(k))} - 1 AS px_to_ma{k}" for k in (20, 50, 100, 200)]
    + [f"{_div(_ma(20), _ma(50))} - 1 AS ma20_to_ma50", f"{_div(_ma(50), _ma(200))} - 1 AS ma50_to_ma200"]
    + [f"{_div('close', _roll(f, c, k))} - 1 AS dist_to_{n}_{c}" for k, n in ((20, "20d"), (YEAR, "52w")) for f, c in (("max", "high"), ("min", "low"))]
    + [f"coalesce(close > ({_roll('max', 'high', 20, skip=1)}), false)::BIGINT AS breakout_20d_up", f"coalesce(close < ({_roll('min', 'low', 20, skip=1)}), false)::BIGINT AS breakout_20d_down"]
    + [f"(({_roll('avg', 'bench_ret_1 * bench_ret_1', 63, 21)}) - ({_roll('avg', 'bench_ret_1', 63, 21)}) * ({_roll('avg', 'bench_ret_1', 63, 21)})) AS b_var"]
    + [f"(({_roll('avg', 'ret_1 * bench_ret_1', 63, 21)}) - ({_roll('avg', 'ret_1', 63, 21)}) * ({_roll('avg', 'bench_ret_1', 63, 21)})) AS b_cov"]
)
PRICE_CTE = (
    f"{BASE},\nbr AS (SELECT date, "
    + ", ".join(f"close / lag(close, {k}) OVER (ORDER BY date) - 1 AS bench_ret_{k}" for k in (1, *RELATIVE))
    + f" FROM bm),\np1 AS (SELECT mk.*, br.* EXCLUDE (date), {', '.join(_PRICE)} FROM mk LEFT JOIN br USING (date)),\np2 AS (SELECT *, {', '.join(_ROLLING)} FROM p1),\n"
    + "px AS (SELECT *, CASE WHEN gk_sum / 21.0 >= 0 THEN sqrt(gk_sum / 21.0) END AS gk_21, CASE WHEN abs(b_var) > 1e-12 THEN b_cov / b_var END AS beta_estimate, "
    + ", ".join(f"ret_{k} - bench_ret_{k} AS ex_bench_{k}" for k in RELATIVE)
    + " FROM p2)"
)


def _rank(c: str, by: str) -> str:
    ok = f"({c} IS NOT NULL AND coalesce(in_universe, false))"
    return f"""CASE WHEN {ok} THEN (rank() OVER (PARTITION BY {by}, {ok} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {ok}, {c}) - 1) / 2.0::DOUBLE)
  / count(*) OVER (PARTITION BY {by}, {ok}) END"""


RANK_CTE = (
    "sp AS (SELECT px.*, sx.sector, un.in_universe FROM px LEFT JOIN sx USING (security_id) LEFT JOIN un USING (date, security_id)),\nrk AS (SELECT *, "
    + ", ".join([f"{_rank(c, 'date')} AS cs_rank_{c}" for c in RANKED] + [f"{_rank('adv20', 'date')} AS liquidity_rank_20"] + [f"{_rank(c, 'date, sector')} AS sector_rank_{c}" for c in SECTOR_RANKED]
                + [f"ret_{k} - median(ret_{k}) OVER (PARTITION BY date, sector) AS ex_sector_{k}" for k in RELATIVE])
    + " FROM sp)"
)


def _asof_cte(metrics: list[str]) -> str:
    """The latest fact of each metric at the close; expired ones give null."""
    joins = " ".join(
        f"ASOF LEFT JOIN (SELECT security_id, available_from, available_to, metric_value FROM ff WHERE metric_name = '{m}') f{i} ON f{i}.security_id = t.security_id AND f{i}.available_from <= t.as_of"
        for i, m in enumerate(metrics)
    )
    values = ", ".join(f"CASE WHEN f{i}.available_to IS NULL OR t.as_of < f{i}.available_to THEN f{i}.metric_value END AS {m}" for i, m in enumerate(metrics))
    return f"""{FACTS_SQL}, ff AS (SELECT * FROM facts WHERE available_to IS NULL OR available_to > available_from),
t AS (SELECT mk.*, c.close_utc AS as_of, c.session_no FROM mk LEFT JOIN trading_calendar c ON c.session_date = mk.date),
pm AS (SELECT t.security_id, t.date, t.close, t.volume, t.session_no, {values}, CAST(fx.available_from AS DATE) AS filed FROM t {joins}
  ASOF LEFT JOIN (SELECT DISTINCT security_id, available_from FROM ff) fx ON fx.security_id = t.security_id AND fx.available_from <= t.as_of)"""


_CAP = "close * shares_outstanding"


def _average(m: str) -> str:
    return f"coalesce(({m} + {_lag(m, YEAR)}) / 2.0, {m})"


_RATIOS = {
    "book_to_price": _div("book_equity", _CAP), "earnings_yield": _div("net_income_ttm", _CAP), "sales_yield": _div("revenue_ttm", _CAP), "cashflow_yield": _div("operating_cashflow_ttm", _CAP),
    "roe": _div("net_income_ttm", _average("book_equity")), "roa": _div("net_income_ttm", _average("total_assets")), "gross_profitability": _div("gross_profit_ttm", "total_assets"),
    "operating_margin": _div("operating_income_ttm", "revenue_ttm"), "accruals": _div("net_income_ttm - operating_cashflow_ttm", "total_assets"),
    "sales_growth_yoy": _div("revenue_ttm", _lag("revenue_ttm", YEAR)) + " - 1", "earnings_growth_yoy": _div("net_income_ttm", _lag("net_income_ttm", YEAR)) + " - 1",
    "asset_growth_yoy": _div("total_assets", _lag("total_assets", YEAR)) + " - 1", "debt_to_equity": _div("total_debt", "book_equity"),
    "interest_coverage": _div("ebit_ttm", "interest_expense_ttm"), "current_ratio": _div("current_assets", "current_liabilities"),
    "turnover_proxy_21": _roll("avg", "volume::DOUBLE / nullif(shares_outstanding, 0)", 21),
    "days_since_last_filing": "CASE WHEN filed IS NULL THEN NULL WHEN filed = date THEN 0 ELSE session_no - (SELECT count(*) FROM trading_calendar c WHERE c.session_date < filed) - 1 END::BIGINT",
}
FUND_CTE = (
    _asof_cte(list(METRICS))
    + f",\nf1 AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in _RATIOS.items())} FROM pm),\n"
    + """fu AS (SELECT *, (days_since_last_filing > 90)::BIGINT AS fundamental_staleness_90, (days_since_last_filing > 180)::BIGINT AS fundamental_staleness_180,
  (book_to_price IS NULL)::BIGINT AS missing_book_to_price_flag, (roe IS NULL OR roa IS NULL OR gross_profitability IS NULL)::BIGINT AS missing_quality_flag FROM f1)"""
)


def _select(names: list[str], source: str) -> str:
    return "SELECT security_id, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"{c if c in FLAGS else grid_sql(c, **_places(c))} AS {c}" for c in names) + f" FROM {source}"


def _family_sql(name: str) -> str:
    names = [c for c in FAMILIES[name] if c not in ("turnover_proxy_21", "liquidity_rank_20") and not c.startswith("ex_sector")]
    return f"WITH {PRICE_CTE} {_select(names, 'px')}"


_ALL = "al AS (SELECT rk.*, fu.* EXCLUDE (security_id, date, close, volume) FROM rk JOIN fu USING (security_id, date))"
_PAIRS = {n: n.split("_x_") for n in FAMILIES["interactions"]}
SQL = {f"feat_{n}": _family_sql(n) for n in PRICE_FAMILIES} | {
    "feat_sections": f"WITH {PRICE_CTE},\n{RANK_CTE} {_select(SECTIONS, 'rk')}",
    "feat_fundamentals": f"WITH {BASE},\n{FUND_CTE} {_select([*FAMILIES['fundamentals'], *FAMILIES['staleness'], 'turnover_proxy_21'], 'fu')}",
    "feat_interactions": f"WITH {PRICE_CTE},\n{RANK_CTE},\n{FUND_CTE},\n{_ALL},\nia AS (SELECT *, {', '.join(f'{a} * {b} AS {n}' for n, (a, b) in _PAIRS.items())} FROM al),\n"
    + f"ib AS (SELECT *, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in REGISTERED)}) / {len(REGISTERED)}.0::DOUBLE AS feature_coverage_ratio FROM ia) "
    + _select([*FAMILIES["interactions"], "feature_coverage_ratio"], "ib"),
    "feat_beta": f"WITH {PRICE_CTE} {_select(['beta_estimate', *(f'bench_ret_{k}' for k in RELATIVE)], 'px')}",
}

"""Portfolio, backtest, source and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.expr import grid, roll
from quoin.operators.labels import forward_labels
from quoin.operators.portfolio import backtest, capacity_table, capped_weights, constrained_weights, cost_table, fill_ratio, impact, long_short, portfolio_inputs
from quoin.plans.base import benchmark, grid_sql, market
from quoin.plans.labels import LABEL_CTE, feature_base
from quoin.sources.local import benchmark_proxy, select_securities
from quoin.sources.sinks import content_hash, profile, schema_hash
from quoin.session import table


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_short(feature_base(spark, sf_dir, USED).select("date", "security_id", "mom_21_ex1", "beta_estimate", "sector"), "mom_21_ex1", 0.2)


def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta- and sector-neutral weights of every date, under a cap per name."""
    return constrained_weights(_sides(spark, sf_dir)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forward_labels(feature_base(spark, sf_dir, USED), benchmark(spark, sf_dir), (1,))
    sides = long_short(rows, "mom_21_ex1", 0.2).where("side <> 0")
    weight = F.col("side") * 0.5 / F.ceil(F.count(F.lit(1)).over(_day()) / 2)
    return sides.select("date", "security_id", weight.alias("weight"), F.col("label_raw_1d_oo").alias("day_return"), F.col("adv20").alias("capacity"))


def _day():
    from pyspark.sql import Window

    return Window.partitionBy("date")


def capacity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtests of 36 scenarios: nine AUMs by four participation limits."""
    rows = [(f"aum{a:g}_p{p:g}", p, 0.001, float(a)) for a in (1, 5, 10, 50, 100, 500, 1000, 5000, 10000) for p in (0.01, 0.05, 0.1, 0.2)]
    scenarios = spark.createDataFrame(rows, "scenario string, participation double, cost_rate double, aum_multiple double")
    return capacity_table(backtest(_days(spark, sf_dir), scenarios))


def portfolio_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the weights of every date add up to: names, both sides, and how many are beyond the cap."""
    rows = constrained_weights(_sides(spark, sf_dir), name_cap=1.0)
    out = rows.groupBy("date").agg(F.count(F.lit(1)).alias("names"), grid(F.sum(F.greatest("weight", F.lit(0.0)))).alias("long"), grid(-F.sum(F.least("weight", F.lit(0.0)))).alias("short"), F.count_if(F.abs("weight") > 1.0 + 1e-9).alias("beyond"))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def capped_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides filled evenly under a cap per name: where all can be placed, every name of a side has the same weight."""
    sides = _sides(spark, sf_dir).withColumn("score", F.col("mom_21_ex1"))
    return capped_weights(sides, name_cap=1.0).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "security_id", grid("weight").alias("weight"), "refused")


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtests at four cost rates with capacity for every trade."""
    rows = [(f"cost_{c:g}", 1.0, float(c), 1.0) for c in COSTS]
    scenarios = spark.createDataFrame(rows, "scenario string, participation double, cost_rate double, aum_multiple double")
    days = _days(spark, sf_dir).withColumn("capacity", F.lit(1e30))
    return cost_table(backtest(days, scenarios)).select("scenario", grid("net_sharpe", 4).alias("net_sharpe"), grid("max_drawdown", 5).alias("max_drawdown"), grid("final_aum", 1).alias("final_aum"))


def portfolio_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum predictions with liquidity bucket and average volume, from the universe's row or else from the panel's."""
    preds = feature_base(spark, sf_dir, USED).where("mom_21_ex1 IS NOT NULL").select("date", "security_id", F.lit("momentum").alias("model_name"), F.col("mom_21_ex1").alias("raw_prediction"))
    one = lambda name, *columns: table(spark, sf_dir, name).groupBy("date", "security_id").agg(*(F.max(c).alias(n) for c, n in columns))
    universe = one("universe_snapshot", ("adv20_usd_t", "adv20_usd_t"), ("liquidity_bucket", "liquidity_bucket"))
    panel = one("feature_panel", ("adv20", "adv20_usd_t"), ("liquidity_bucket", "liquidity_bucket"), ("sector", "sector"))
    out = portfolio_inputs(preds, universe, panel, "momentum")
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "security_id", grid("raw_prediction").alias("raw_prediction"), grid("adv20_usd_t", 2, 0.51234).alias("adv20_usd_t"), "liquidity_bucket", "sector")


def adv_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average dollar volume of up to twenty rows, from the first row on."""
    rows = market(spark, sf_dir)
    return rows.select("security_id", F.date_format("date", "yyyy-MM-dd").alias("date"), grid(roll(F.avg, "dollar_volume", 20, least=1), 2, 0.51234).alias("adv20"))


def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and nulls of every column of the domain tables."""
    out = None
    for n in PROFILED:
        one = profile(table(spark, sf_dir, n)).withColumn("table_name", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


#: Features that portfolios here use.
USED = {"mom_21_ex1", "beta_estimate", "adv20"}
COSTS = (0.0, 0.0005, 0.001, 0.002)
PROFILED = ("security_master", "silver_market", "silver_fundamentals", "universe_snapshot")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill ratios and square-root impact of equal trades of every row against its average volume."""
    rows = feature_base(spark, sf_dir, USED).select("security_id", "date", F.lit(0.02).alias("trade"), F.lit(1e10).alias("aum"), "adv20")
    ratio = fill_ratio("trade", "aum", "adv20", 0.1)
    part = F.try_divide(F.col("trade") * F.col("aum") * ratio, "adv20")
    return rows.select("security_id", F.date_format("date", "yyyy-MM-dd").alias("date"), grid(ratio).alias("fill_ratio"), grid(impact(part, 1.0, 10.0)).alias("impact"))


def benchmark_from_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = table(spark, sf_dir, "silver_market").select("security_id", "trade_date", "open", "high", "low", "close").distinct()
    out = benchmark_proxy(market)
    return out.select(F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), *(grid(c, 4, 0.51234).alias(c) for c in ("open", "high", "low", "close")))


def security_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty securities of the last snapshot, in order of preference: a top-k report."""
    master = table(spark, sf_dir, "security_master")
    last = master.agg(F.max("snapshot_date").alias("d"))
    rows = master.join(F.broadcast(last), F.col("snapshot_date") == F.col("d")).select("security_id", "symbol", "exchange", "is_common_stock").distinct()
    return select_securities(rows, 20).select("security_id")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON properties as typed values, summed by event type."""
    events = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return events.groupBy("event_type").agg(F.count("k").alias("present"), F.sum("k").alias("total"), F.max("k").alias("most"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive content and schema hashes of the domain tables."""
    rows = [(n, content_hash(df), schema_hash(df), df.count()) for n in PROFILED for df in [table(spark, sf_dir, n)]]
    return spark.createDataFrame(rows, "table_name string, content_hash string, schema_hash string, rows long")


QUERIES = {f.__name__: f for f in (portfolio_weights, portfolio_checks, capped_allocation, portfolio_frame, adv_from_start, cost_sensitivity, capacity_grid, fills, benchmark_from_market, security_selection, event_props, content_hashes, table_profiles)}

_RATIO = "least(1, coalesce(adv20, 0) * 0.1 / (0.02::DOUBLE * 1e10))"
PROFILE_COLUMNS = {
    "security_master": "security_id symbol security_type exchange listing_date delisting_date sector industry country currency is_common_stock snapshot_date loaded_at".split(),
    "silver_market": "security_id trade_date open high low close adj_close volume dollar_volume is_price_valid is_volume_valid tradable_flag_prelim data_quality_score data_version".split(),
    "silver_fundamentals": "fact_id security_id source_company_id form_type filing_date acceptance_datetime fiscal_period_end metric_name_canonical metric_value metric_unit statement_type available_from available_to is_latest_known_as_of_date staleness_days is_restatement data_version".split(),
    "universe_snapshot": "date security_id is_in_universe exclusion_reason_code price_t adv20_usd_t feature_coverage_ratio data_quality_score liquidity_bucket".split(),
}
# sides of every date and their even weights
_SIDES = f"""WITH {LABEL_CTE}, sr AS (SELECT px.security_id, px.date, mom_21_ex1, ceil(count(mom_21_ex1) OVER (PARTITION BY px.date) * 0.2::DOUBLE) AS n, label_raw_1d_oo,
  row_number() OVER (PARTITION BY px.date ORDER BY mom_21_ex1 DESC NULLS LAST, px.security_id) AS u, row_number() OVER (PARTITION BY px.date ORDER BY mom_21_ex1 NULLS LAST, px.security_id) AS d
  FROM px JOIN ll USING (security_id, date)),
sd AS (SELECT *, CASE WHEN u <= n THEN 1 WHEN d <= n THEN -1 ELSE 0 END AS side FROM sr WHERE mom_21_ex1 IS NOT NULL),
ss AS (SELECT *, count(*) OVER (PARTITION BY date) AS k, count(*) OVER (PARTITION BY date, side) AS ks FROM sd WHERE side <> 0)"""
_COST = f"""{_SIDES}, w AS (SELECT date, security_id, side * 0.5::DOUBLE / ceil(k / 2) AS w, coalesce(label_raw_1d_oo, 0) AS r, dense_rank() OVER (ORDER BY date) AS i FROM ss),
tr AS (SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS t FROM w a FULL JOIN w b ON a.security_id = b.security_id AND a.i = b.i + 1 GROUP BY 1),
gr AS (SELECT i, date, sum(w * r) AS g FROM w GROUP BY 1, 2),
cs AS (SELECT unnest({list(COSTS)!r}::DOUBLE[]) AS c),
nt AS (SELECT c, i, date, g - c * t AS r FROM gr JOIN tr USING (i), cs),
cv AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY c ORDER BY i)) AS e FROM nt),
cw AS (SELECT *, e / greatest(1, max(e) OVER (PARTITION BY c ORDER BY i)) - 1 AS dd FROM cv)"""
_ONE = "SELECT date, security_id, {0} FROM {1} GROUP BY 1, 2"
SQL = {
    "fills": f"""WITH {LABEL_CTE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, {grid_sql(_RATIO)} AS fill_ratio,
  {grid_sql(f'1 + 10 * sqrt(coalesce(0.02::DOUBLE * 1e10 * {_RATIO} / nullif(adv20, 0), 0))')} AS impact FROM px""",
    "benchmark_from_market": "WITH m AS (SELECT DISTINCT security_id, trade_date, open, high, low, close FROM silver_market) SELECT strftime(trade_date, '%Y-%m-%d') AS trade_date, "
    + ", ".join(f"{grid_sql(f'avg({c})', 4, 0.51234)} AS {c}" for c in ("open", "high", "low", "close"))
    + " FROM m GROUP BY m.trade_date",
    "security_selection": """WITH m AS (SELECT DISTINCT security_id, symbol, exchange, is_common_stock FROM security_master WHERE snapshot_date = (SELECT max(snapshot_date) FROM security_master))
SELECT security_id FROM m ORDER BY coalesce(is_common_stock, false) DESC, coalesce(upper(exchange) IN ('NYSE', 'NASDAQ'), false) DESC, coalesce(regexp_matches(symbol, '^[A-Z]{1,5}$'), false) DESC,
  symbol NULLS LAST, security_id LIMIT 20""",
    "event_props": "SELECT event_type, count(props->>'$.k') AS present, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS most FROM events GROUP BY 1",
    "portfolio_checks": f"""{_SIDES} SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS names, {grid_sql('CASE WHEN count(*) FILTER (WHERE side > 0) > 0 THEN 0.5 ELSE 0 END')} AS long,
  {grid_sql('CASE WHEN count(*) FILTER (WHERE side < 0) > 0 THEN 0.5 ELSE 0 END')} AS short, 0::BIGINT AS beyond FROM ss GROUP BY ss.date""",
    "capped_allocation": f"{_SIDES} SELECT strftime(date, '%Y-%m-%d') AS date, security_id, {grid_sql('side * 0.5::DOUBLE / ks')} AS weight, false AS refused FROM ss",
    "cost_sensitivity": f"""{_COST} SELECT 'cost_' || CASE c WHEN 0 THEN '0' WHEN 0.0005 THEN '0.0005' WHEN 0.001 THEN '0.001' ELSE '0.002' END AS scenario,
  {grid_sql('avg(r) / stddev_pop(r) * sqrt(252)', 4)} AS net_sharpe, {grid_sql('min(dd)', 5)} AS max_drawdown, {grid_sql('1000000 * arg_max(e, i)', 1)} AS final_aum FROM cw GROUP BY c""",
    "portfolio_frame": f"""WITH {LABEL_CTE}, us AS ({_ONE.format('max(adv20_usd_t) AS a, max(liquidity_bucket) AS b', 'universe_snapshot')}),
fp AS ({_ONE.format('max(adv20) AS fa, max(liquidity_bucket) AS fb_, max(sector) AS sector', 'feature_panel')})
SELECT strftime(date, '%Y-%m-%d') AS date, security_id, {grid_sql('mom_21_ex1')} AS raw_prediction, {grid_sql('coalesce(a, fa)', 2, 0.51234)} AS adv20_usd_t, coalesce(b, fb_) AS liquidity_bucket, sector
FROM px LEFT JOIN us USING (date, security_id) LEFT JOIN fp USING (date, security_id) WHERE mom_21_ex1 IS NOT NULL""",
    "adv_from_start": f"""WITH m AS (SELECT DISTINCT security_id, trade_date AS date, open, high, low, close, volume, dollar_volume FROM silver_market),
a AS (SELECT security_id, date, avg(dollar_volume) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM m)
SELECT security_id, strftime(date, '%Y-%m-%d') AS date, {grid_sql('v', 2, 0.51234)} AS adv20 FROM a""",
    "table_profiles": " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, column_name, rows, nulls FROM (SELECT count(*) AS rows, unnest([{', '.join(f"'{c}'" for c in columns)}]) AS column_name, unnest([{', '.join(f'count(*) - count({c})' for c in columns)}]) AS nulls FROM {n})"""
        for n, columns in PROFILE_COLUMNS.items()
    ),
}

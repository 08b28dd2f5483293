"""Domain tables as the panel operators want them, in Spark and in DuckDB. Exact duplicates count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.expr import TAIL
from quoin.functions.text import tidy
from quoin.session import table


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """silver_market with its exact duplicates."""
    columns = ("open", "high", "low", "close", "volume", "dollar_volume")
    return table(spark, sf_dir, "silver_market").select("security_id", F.col("trade_date").alias("date"), *columns)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of silver_market once. Rows move by security before copies are dropped, so that all windows by security run where they lie."""
    return market_rows(spark, sf_dir).repartition("security_id").distinct()


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivered sector and symbol of each security."""
    rows = table(spark, sf_dir, "security_master").select("security_id", "snapshot_date", "loaded_at", tidy("sector").alias("sector"), tidy("symbol").alias("symbol"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("snapshot_date", "loaded_at", c)))[c].alias(c)
    return rows.groupBy("security_id").agg(last("sector"), last("symbol"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "universe_snapshot").groupBy("date", "security_id").agg(F.bool_or("is_in_universe").alias("in_universe"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark_market")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trading_calendar")


BASE = r"""mk AS (SELECT DISTINCT security_id, trade_date AS date, open, high, low, close, volume, dollar_volume FROM silver_market),
sm0 AS (SELECT security_id, snapshot_date, loaded_at, nullif(upper(regexp_replace(sector, '\s+', '', 'g')), '') AS sector,
  nullif(upper(regexp_replace(symbol, '\s+', '', 'g')), '') AS symbol FROM security_master),
sx AS (SELECT security_id, arg_max(sector, (snapshot_date, loaded_at, sector)) FILTER (WHERE sector IS NOT NULL) AS sector,
  arg_max(symbol, (snapshot_date, loaded_at, symbol)) FILTER (WHERE symbol IS NOT NULL) AS symbol FROM sm0 GROUP BY security_id),
un AS (SELECT date, security_id, bool_or(is_in_universe) AS in_universe FROM universe_snapshot GROUP BY 1, 2),
bm AS (SELECT trade_date AS date, open, close FROM benchmark_market)"""


def grid_sql(x: str, places: int = 6, half: float = 0.5) -> str:
    """The counterpart of quoin.functions.expr.grid; NaN and infinities become null."""
    return f"CASE WHEN isfinite(({x})::DOUBLE) THEN floor(({x})::DOUBLE * {10.0**places}::DOUBLE + {half}::DOUBLE) / {10.0**places}::DOUBLE END"


def normal_cdf_sql(x: str) -> str:
    """The counterpart of quoin.functions.expr.normal_cdf."""
    a = f"abs({x})"
    top, bottom = ((lambda terms: "".join(["("] * (len(terms) - 1)) + f"{terms[0]!r}::DOUBLE" + "".join(f" * {a} + {t!r}::DOUBLE)" for t in terms[1:]))(terms) for terms in TAIL)
    tail = f"CASE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2.0::DOUBLE) * {top} / {bottom} ELSE 0 END"
    return f"CASE WHEN ({x}) > 0 THEN 1 - ({tail}) WHEN ({x}) IS NOT NULL THEN {tail} END"

"""Problem 3 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.regular import regular_grid
from quoin.session import table

SERIES = ["security_id", "provider_name"]


def _grid(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    rows = table(spark, sf_dir, "bronze_market")
    calendar = table(spark, sf_dir, "trading_calendar")
    return regular_grid(rows, SERIES, "trade_date", "close", ["data_version", "ingested_at", "record_id"], calendar, "session_date", "session_no", whole=whole)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, False).where("status = 'filled'").select(*SERIES, F.date_format("day", "yyyy-MM-dd").alias("session_day"))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series and session: the close, observed or imputed, and which of the two."""
    return _grid(spark, sf_dir, True).select(*SERIES, F.col("slot").alias("session_no"), F.date_format("day", "yyyy-MM-dd").alias("session_day"), F.col("value").alias("close"), "status")


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without what is imputed: each slot's status, and the close where it was observed."""
    return p3_grid(spark, sf_dir).withColumn("close", F.when(F.col("status") == "observed", F.col("close")))


QUERIES = {"p3_found": p3_found, "p3_grid": p3_grid, "p3_status": p3_status}
SQL = {
    "p3_found": """WITH r AS (SELECT DISTINCT security_id, provider_name, session_no FROM bronze_market JOIN trading_calendar ON session_date = trade_date WHERE close IS NOT NULL),
b AS (SELECT security_id, provider_name, min(session_no) lo, max(session_no) hi FROM r GROUP BY 1, 2)
SELECT b.security_id, b.provider_name, strftime(c.session_date, '%Y-%m-%d') AS session_day FROM b JOIN trading_calendar c ON c.session_no BETWEEN lo AND hi
ANTI JOIN r ON r.security_id = b.security_id AND r.provider_name = b.provider_name AND r.session_no = c.session_no""",
    "p3_status": """WITH r AS (SELECT security_id, provider_name, session_no, close FROM bronze_market JOIN trading_calendar ON session_date = trade_date WHERE close IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY security_id, provider_name, session_no ORDER BY data_version DESC, ingested_at DESC, record_id DESC) = 1),
b AS (SELECT security_id, provider_name, min(session_no) lo, max(session_no) hi FROM r GROUP BY 1, 2)
SELECT b.security_id, b.provider_name, c.session_no, strftime(c.session_date, '%Y-%m-%d') AS session_day, r.close,
  CASE WHEN r.session_no IS NOT NULL THEN 'observed' WHEN c.session_no BETWEEN lo AND hi THEN 'filled' ELSE 'outside' END AS status
FROM b CROSS JOIN trading_calendar c LEFT JOIN r ON r.security_id = b.security_id AND r.provider_name = b.provider_name AND r.session_no = c.session_no""",
}

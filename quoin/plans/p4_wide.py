"""Problem 4 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import plain_name
from quoin.operators.wide import cells_of, wide_by_position
from quoin.plans.facts import FACTS_SQL
from quoin.session import table


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    names = table(spark, sf_dir, "metric_dictionary").select("metric_name", "value_type")
    attributes = dict(sorted((r[0], r[1]) for r in names.collect()))  # a fixed table: the columns of the result
    facts = table(spark, sf_dir, "silver_fundamentals").select("security_id", "fact_id", "metric_name_canonical", "metric_value", "available_from", "available_to")
    known = names.select("metric_name", plain_name("metric_name").alias("plain"))
    facts = facts.withColumn("plain", plain_name("metric_name_canonical")).join(known, "plain", "left")
    open_ended = F.col("available_to").isNull()
    return wide_by_position(facts, "security_id", "metric_name", "metric_value", "fact_id", "available_from", attributes, eligible=open_ended), attributes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, attributes = _wide(spark, sf_dir)
    return cells_of(wide, "security_id", list(attributes)).select("security_id", F.col("attribute").alias("metric_name"), F.col("id").alias("fact_id"))


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per security with a typed column per metric."""
    wide, attributes = _wide(spark, sf_dir)
    return wide.select("security_id", *attributes)


QUERIES = {"p4_found": p4_found, "p4_wide": p4_wide}

_CELLS = f"""WITH {FACTS_SQL}, w AS (
  SELECT * FROM facts WHERE available_to IS NULL
  QUALIFY row_number() OVER (PARTITION BY security_id, metric_name ORDER BY available_from DESC, fact_id DESC) = 1),
c AS (SELECT security_id, metric_name, fact_id, metric_value AS v FROM w WHERE metric_value IS NOT NULL AND isfinite(metric_value)
  AND (value_type = 'double' OR (value_type = 'long' AND metric_value = floor(metric_value)) OR (value_type = 'boolean' AND metric_value IN (0, 1))))"""

#: The columns of p4_wide: fixed values of metric_dictionary.
_COLUMNS = {
    "double": "book_equity net_income_ttm revenue_ttm operating_cashflow_ttm gross_profit_ttm operating_income_ttm total_assets total_debt ebit_ttm "
    "interest_expense_ttm current_assets current_liabilities dividend_per_share rnd_expense_ttm deposits_total",
    "bigint": "shares_outstanding employee_count segment_count",
    "boolean": "is_dividend_payer is_audited",
}

SQL = {
    "p4_found": f"{_CELLS} SELECT security_id, metric_name, fact_id FROM c",
    "p4_wide": f"{_CELLS} SELECT s.security_id, "
    + ", ".join(f"CAST(max(c.v) FILTER (WHERE c.metric_name = '{m}') AS {kind}) AS {m}" for kind, names in _COLUMNS.items() for m in names.split())
    + " FROM (SELECT DISTINCT security_id FROM silver_fundamentals) s LEFT JOIN c ON c.security_id = s.security_id GROUP BY s.security_id",
}

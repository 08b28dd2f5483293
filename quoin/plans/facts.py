"""Facts with their dictionary metric."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import plain_name
from quoin.session import table

#: The same in DuckDB.
FACTS_SQL = """facts AS (
  SELECT DISTINCT s.fact_id, s.security_id, s.metric_value, s.available_from, s.available_to, m.metric_name, m.value_type
  FROM silver_fundamentals s JOIN metric_dictionary m
    ON lower(regexp_replace(s.metric_name_canonical, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(m.metric_name, '[^A-Za-z0-9]', '', 'g')))"""


def metric_facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """silver_fundamentals with metric_name and value_type of its dictionary row; rows of no metric are left out."""
    facts = table(spark, sf_dir, "silver_fundamentals").select("security_id", "metric_name_canonical", *columns)
    names = table(spark, sf_dir, "metric_dictionary").select("metric_name", "value_type", plain_name("metric_name").alias("plain"))
    return facts.withColumn("plain", plain_name("metric_name_canonical")).join(names, "plain").drop("plain", "metric_name_canonical")

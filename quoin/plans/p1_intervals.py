"""Problem 1 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.intervals import interval_map
from quoin.plans.facts import FACTS_SQL, metric_facts


def _map(spark: SparkSession, sf_dir: str, pairs: bool) -> DataFrame:
    facts = metric_facts(spark, sf_dir, "fact_id", "available_from", "available_to")
    return interval_map(facts, ["security_id", "metric_name"], "available_from", "available_to", "fact_id", pairs=pairs)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _map(spark, sf_dir, True).where("kind <> 'period'")
    return found.select("kind", F.col("id_1").alias("fact_id_1"), F.col("id_2").alias("fact_id_2"))


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of availability and the gaps between them."""
    found = _map(spark, sf_dir, False)
    return found.select("security_id", "metric_name", "kind", F.col("t_start").cast("timestamp_ntz").alias("starts"), F.col("t_end").cast("timestamp_ntz").alias("ends"))


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods}

_COVER = FACTS_SQL + """, c AS (
  SELECT security_id, metric_name, fact_id, available_from a, coalesce(available_to, TIMESTAMP '9999-01-01') b FROM facts
  WHERE available_to IS NULL OR available_to > available_from),
m AS (SELECT *, max(b) OVER (PARTITION BY security_id, metric_name ORDER BY a, b, fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM c),
g AS (SELECT security_id, metric_name, reach AS s, min(a) AS e FROM m WHERE a > reach GROUP BY 1, 2, 3)"""

SQL = {
    "p1_found": f"""WITH {_COVER}
SELECT 'overlap' AS kind, x.fact_id AS fact_id_1, y.fact_id AS fact_id_2 FROM c x JOIN c y
  ON x.security_id = y.security_id AND x.metric_name = y.metric_name AND x.fact_id < y.fact_id AND x.a < y.b AND y.a < x.b
UNION ALL
SELECT 'gap', least(p, q), greatest(p, q) FROM (
  SELECT (SELECT min(fact_id) FROM c WHERE c.security_id = g.security_id AND c.metric_name = g.metric_name AND c.b = g.s) p,
         (SELECT min(fact_id) FROM c WHERE c.security_id = g.security_id AND c.metric_name = g.metric_name AND c.a = g.e) q FROM g)""",
    "p1_periods": f"""WITH {_COVER},
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY security_id, metric_name ORDER BY a, b, fact_id) island FROM m)
SELECT security_id, metric_name, 'period' AS kind, min(a) AS starts, nullif(max(b), TIMESTAMP '9999-01-01') AS ends FROM n GROUP BY security_id, metric_name, island
UNION ALL SELECT security_id, metric_name, 'gap', s, e FROM g""",
}

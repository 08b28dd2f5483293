"""Problem 2 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.known import as_known
from quoin.plans.facts import FACTS_SQL, metric_facts
from quoin.session import table

#: The metrics that feature_panel claims to hold.
CLAIMED = ("book_equity", "revenue_ttm", "total_assets")


def _known(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    facts = metric_facts(spark, sf_dir, "fact_id", "metric_value", "available_from", "available_to")
    panel = table(spark, sf_dir, "feature_panel").select("panel_id", "security_id", "as_of_timestamp", *columns)
    return as_known(
        panel, facts, ["security_id"], CLAIMED, event_known="as_of_timestamp", event_valid="as_of_timestamp", attribute="metric_name",
        known="available_from", valid_from="available_from", valid_to="available_to", value="metric_value", fact_id="fact_id",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir, *CLAIMED).where(F.col("as_of_timestamp").isNotNull())
    wrong = [F.when(~F.col(m).eqNullSafe(F.col(f"known_{m}")), F.lit(m)) for m in CLAIMED]
    return known.select("panel_id", F.explode(F.array_compact(F.array(*wrong))).alias("metric_name")).distinct()


def p2_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel row with the values known at its as_of_timestamp."""
    return _known(spark, sf_dir).drop("as_of_timestamp")


QUERIES = {"p2_found": p2_found, "p2_known": p2_known}


def _asof(metric: str, columns: str) -> str:
    return f"""(SELECT p.panel_id, p.rn, f.metric_value AS v, f.fact_id AS i FROM p JOIN facts f
    ON f.security_id = p.security_id AND f.metric_name = '{metric}' AND f.available_from <= p.as_of_timestamp
    AND (f.available_to IS NULL OR p.as_of_timestamp < f.available_to)
    QUALIFY row_number() OVER (PARTITION BY p.rn ORDER BY f.available_from DESC, f.fact_id DESC) = 1) {columns}"""


_EVENTS = f"WITH {FACTS_SQL}, p AS (SELECT *, row_number() OVER () AS rn FROM feature_panel)"
_JOINS = " ".join(f"LEFT JOIN {_asof(m, f'x{i}')} ON x{i}.rn = p.rn" for i, m in enumerate(CLAIMED))

SQL = {
    "p2_found": _EVENTS
    + " SELECT DISTINCT panel_id, metric_name FROM ("
    + " UNION ALL ".join(
        f"SELECT p.panel_id, '{m}' AS metric_name FROM p LEFT JOIN {_asof(m, 'x')} ON x.rn = p.rn WHERE p.as_of_timestamp IS NOT NULL AND p.{m} IS DISTINCT FROM x.v"
        for m in CLAIMED
    )
    + ")",
    "p2_known": _EVENTS + " SELECT p.panel_id, p.security_id, " + ", ".join(f"x{i}.v AS known_{m}, x{i}.i AS fact_{m}" for i, m in enumerate(CLAIMED)) + f" FROM p {_JOINS}",
}

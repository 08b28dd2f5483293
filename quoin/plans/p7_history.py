"""Problem 7 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import tidy
from quoin.operators.history import attribute_history
from quoin.session import table


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "security_master").select(
        "security_id", "snapshot_date", "loaded_at", "listing_date", "delisting_date", tidy("symbol").alias("symbol"), tidy("sector").alias("sector")
    )
    return attribute_history(rows, ["security_id"], "snapshot_date", "loaded_at", ["symbol", "listing_date", "sector"], ["delisting_date"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("security_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from_day"))


def p7_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of each security with its period; symbol and sector in upper case without white space."""
    days = ("valid_from", "valid_to", "listing_date", "delisting_date")
    return _history(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in days})


QUERIES = {"p7_found": p7_found, "p7_history": p7_history}

_TIDY = "nullif(upper(regexp_replace({0}, '\\s+', '', 'g')), '') AS {0}"
_VERSIONS = f"""WITH one AS (
  SELECT security_id, snapshot_date, loaded_at, listing_date, delisting_date, {_TIDY.format('symbol')}, {_TIDY.format('sector')} FROM security_master
  QUALIFY row_number() OVER (PARTITION BY security_id, snapshot_date ORDER BY loaded_at DESC NULLS LAST) = 1),
s AS (SELECT security_id, snapshot_date, delisting_date, last_value(symbol IGNORE NULLS) OVER w AS symbol,
  last_value(listing_date IGNORE NULLS) OVER w AS listing_date, last_value(sector IGNORE NULLS) OVER w AS sector
  FROM one WINDOW w AS (PARTITION BY security_id ORDER BY snapshot_date)),
p AS (SELECT *, row_number() OVER w AS n, lag(symbol) OVER w AS p1, lag(listing_date) OVER w AS p2, lag(delisting_date) OVER w AS p3, lag(sector) OVER w AS p4
  FROM s WINDOW w AS (PARTITION BY security_id ORDER BY snapshot_date)),
v AS (SELECT * FROM p WHERE n = 1 OR symbol IS DISTINCT FROM p1 OR listing_date IS DISTINCT FROM p2 OR delisting_date IS DISTINCT FROM p3 OR sector IS DISTINCT FROM p4)"""

SQL = {
    "p7_found": f"{_VERSIONS} SELECT security_id, strftime(snapshot_date, '%Y-%m-%d') AS valid_from_day FROM v",
    "p7_history": f"""{_VERSIONS}, h AS (SELECT *, lead(snapshot_date) OVER (PARTITION BY security_id ORDER BY snapshot_date) AS next FROM v)
SELECT security_id, symbol, sector, """
    + ", ".join(f"strftime({c}, '%Y-%m-%d') AS {n}" for c, n in (("snapshot_date", "valid_from"), ("next", "valid_to"), ("listing_date", "listing_date"), ("delisting_date", "delisting_date")))
    + " FROM h",
}

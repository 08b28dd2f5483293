"""Problem 5 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.operators.trailing import rolling
from quoin.session import table

#: Sessions of universe_snapshot.adv20_usd_t, and its tolerance.
SESSIONS, TOLERANCE = 20, 0.01


def _market(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """silver_market without exact duplicates, by security; a security has one row a session."""
    return table(spark, sf_dir, "silver_market").select("security_id", "trade_date", *columns).repartition("security_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market rows and claims go through one exchange by security; a claim waits on the grid row of its session until the window has passed."""
    sessions = table(spark, sf_dir, "trading_calendar").select("session_date", "session_no")
    following = F.lead("session_date").over(Window.orderBy("session_no"))  # 752 rows, fixed
    spans = sessions.select("session_date", F.coalesce(F.date_sub(following, 1), F.col("session_date")).alias("until"))
    days = spans.select(F.col("session_date").alias("at"), F.explode(F.sequence("session_date", "until")).alias("date"))
    first, last = sessions.agg(F.min("session_date"), F.max("session_date")).first()
    claims = table(spark, sf_dir, "universe_snapshot").where("adv20_usd_t IS NOT NULL").select("security_id", "date", "adv20_usd_t")
    # the last session on or before the claim's day
    placed = claims.join(days, "date", "left").withColumn("at", F.when(F.col("date") > F.lit(last), F.lit(last)).otherwise(F.col("at")))
    market = table(spark, sf_dir, "silver_market").select("security_id", F.col("trade_date").alias("at"), "dollar_volume")
    rows = market.unionByName(placed, allowMissingColumns=True).repartition("security_id").distinct()
    # of several claims for a day the least and the greatest tell whether one is wrong
    daily = rows.groupBy("security_id", "at", "date").agg(F.sum("dollar_volume").alias("dollar_volume"), F.min("adv20_usd_t").alias("low"), F.max("adv20_usd_t").alias("high"))
    claimed = F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "low", "high")))
    totals = rolling(daily, ["security_id"], "at", sessions, "session_date", "session_no", {"dollar_volume": [SESSIONS]}, {"claims": claimed})
    checked = totals.select("security_id", (F.col(f"dollar_volume_sum_{SESSIONS}") / SESSIONS).alias("true"), F.explode("claims").alias("c")).select("security_id", "true", "c.*")
    off = lambda c: F.abs(F.col(c) - F.col("true")) > TOLERANCE * F.abs("true")
    wrong = checked.where(off("low") | off("high")).select("security_id", "date")
    # before the first session nothing was traded
    early = claims.where((F.lit(first).isNull() | (F.col("date") < F.lit(first))) & (F.col("adv20_usd_t") != 0)).select("security_id", "date").distinct()
    return wrong.unionByName(early).select("security_id", F.date_format("date", "yyyy-MM-dd").alias("snapshot_day"))


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages over the 7 and 30 days that end on each day, from the first session to the last. Volume averages are per
    day of the period, close averages per close in it. Sums are exact: values count as whole thousandths."""
    market = _market(spark, sf_dir, "dollar_volume", "close")
    exact = market.select("security_id", "trade_date", *(F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("dollar_volume", "close")))
    span = table(spark, sf_dir, "trading_calendar").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select("a", F.explode(F.sequence("a", "b")).alias("day")).select("day", (F.date_diff("day", "a") + 1).alias("no"))
    totals = rolling(exact, ["security_id"], "trade_date", days, "day", "no", {"dollar_volume": [7, 30], "close": [7, 30]})
    out = [F.col("security_id"), F.col("day_no").cast("long").alias("day_no")]
    for k in (7, 30):
        out += [
            (F.col(f"dollar_volume_sum_{k}") / 1000.0).alias(f"dollar_volume_total_{k}d"),
            (F.col(f"dollar_volume_sum_{k}") / (1000.0 * k)).alias(f"dollar_volume_avg_{k}d"),
            F.try_divide(F.col(f"close_sum_{k}").cast("double"), 1000.0 * F.col(f"close_n_{k}")).alias(f"close_avg_{k}d"),
            F.col(f"close_n_{k}").alias(f"days_{k}d"),
        ]
    return totals.select(*out)


QUERIES = {"p5_found": p5_found, "p5_trailing": p5_trailing}

SQL = {
    "p5_found": f"""WITH m AS (SELECT DISTINCT security_id, trade_date, dollar_volume FROM silver_market),
d AS (SELECT m.security_id, c.session_no, sum(dollar_volume) dv FROM m JOIN trading_calendar c ON c.session_date = m.trade_date GROUP BY 1, 2),
u AS (SELECT DISTINCT security_id, date, adv20_usd_t, (SELECT max(session_no) FROM trading_calendar c WHERE c.session_date <= date) AS n
  FROM universe_snapshot WHERE adv20_usd_t IS NOT NULL),
t AS (SELECT u.security_id, u.date, u.adv20_usd_t, coalesce(sum(d.dv), 0) / {SESSIONS} AS v FROM u LEFT JOIN d
  ON d.security_id = u.security_id AND d.session_no BETWEEN u.n - {SESSIONS - 1} AND u.n GROUP BY 1, 2, 3)
SELECT DISTINCT security_id, strftime(date, '%Y-%m-%d') AS snapshot_day FROM t WHERE abs(adv20_usd_t - v) > {TOLERANCE} * abs(v)""",
    "p5_trailing": """WITH m AS (SELECT DISTINCT security_id, trade_date, dollar_volume, close FROM silver_market),
span AS (SELECT min(session_date) a, max(session_date) b FROM trading_calendar),
days AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day, a FROM span),
g AS (SELECT s.security_id, d.day, date_diff('day', d.a, d.day) + 1 AS day_no FROM (SELECT DISTINCT security_id FROM m) s, days d),
x AS (SELECT g.security_id, g.day_no, CAST(round(m.dollar_volume * 1000) AS BIGINT) dv, CAST(round(m.close * 1000) AS BIGINT) cl
  FROM g LEFT JOIN m ON m.security_id = g.security_id AND m.trade_date = g.day)
SELECT security_id, day_no, """
    + ", ".join(
        f"""CAST(coalesce(sum(dv) OVER w{k}, 0) AS DOUBLE) / 1000.0::DOUBLE AS dollar_volume_total_{k}d, CAST(coalesce(sum(dv) OVER w{k}, 0) AS DOUBLE) / {1000.0 * k}::DOUBLE AS dollar_volume_avg_{k}d,
CASE WHEN count(cl) OVER w{k} > 0 THEN CAST(sum(cl) OVER w{k} AS DOUBLE) / (1000.0::DOUBLE * count(cl) OVER w{k}) END AS close_avg_{k}d, count(cl) OVER w{k} AS days_{k}d"""
        for k in (7, 30)
    )
    + " FROM x WINDOW "
    + ", ".join(f"w{k} AS (PARTITION BY security_id ORDER BY day_no ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (7, 30)),
}

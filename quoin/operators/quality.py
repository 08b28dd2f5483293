"""Quality checks: typed flags per row, missing sessions, issue rows and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import div

FLAGS = ("invalid_ohlc", "invalid_price_nonpositive", "invalid_volume", "duplicate_key", "unexplained_jump")
JUMP = 0.5


def market_flags(rows: DataFrame, splits: DataFrame, keys: Sequence[str], day: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with close_return (against the previous row of ``keys``), the flags and jump_explained (a split of that security and day).
    Null prices and volumes raise no flag. Jumps are moves beyond JUMP."""
    high, low, open_, close = (F.col(c) for c in ("high", "low", "open", "close"))
    before = F.lag("close").over(Window.partitionBy(*keys).orderBy(day, *order))
    false = F.lit(False)
    checked = rows.withColumns({
        "close_return": div("close", before) - 1,
        "invalid_ohlc": F.coalesce((high < F.greatest(open_, close, low)) | (low > F.least(open_, close, high)), false),
        "invalid_price_nonpositive": F.coalesce(F.least(open_, high, low, close) <= 0, false),
        "invalid_volume": F.coalesce(F.col("volume") < 0, false),
        "duplicate_key": F.count(F.lit(1)).over(Window.partitionBy(*keys, day)) > 1,
    })
    events = splits.select(F.col("security_id"), F.col("split_day").alias(day)).distinct().withColumn("jump_explained", F.lit(True))
    jump = F.coalesce(F.abs("close_return") > JUMP, false)
    out = checked.join(events, ["security_id", day], "left").withColumn("jump_explained", F.coalesce("jump_explained", false))
    return out.withColumns({"extreme_jump": jump, "unexplained_jump": jump & ~F.col("jump_explained")})


def scored(flagged: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """data_quality_score: one less a fifth per flag, at least zero; is_price_valid, is_volume_valid and tradable_flag."""
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    price = ~(F.col("invalid_ohlc") | F.col("invalid_price_nonpositive") | F.col("unexplained_jump"))
    return flagged.withColumns({
        "data_quality_score": F.greatest(1.0 - 0.2 * total, F.lit(0.0)), "is_price_valid": price, "is_volume_valid": ~F.col("invalid_volume"),
        "tradable_flag": price & ~F.col("invalid_volume") & ~F.col("duplicate_key"),
    })


def issues(flagged: DataFrame, keep: Sequence[str], flags: Sequence[str] = FLAGS) -> DataFrame:
    """One row per row and raised flag, from one scan."""
    raised = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))
    return flagged.select(*keep, F.explode(raised).alias("issue"))


def summary(scored_rows: DataFrame, missing: DataFrame) -> DataFrame:
    """One row of counts over ``scored`` rows, with the number of ``missing`` sessions and the mean score."""
    n = F.count(F.lit(1))
    counts = scored_rows.agg(
        n.alias("rows_total"), F.count_if("invalid_ohlc").alias("invalid_ohlc_rows"), F.count_if("invalid_volume").alias("invalid_volume_rows"), F.count_if("duplicate_key").alias("duplicate_rows"),
        F.count_if("unexplained_jump").alias("unexplained_jump_rows"), F.coalesce(F.avg("data_quality_score"), F.lit(0.0)).alias("mean_score"),
    )
    return counts.withColumn("k_", F.lit(0)).join(missing.agg(n.alias("missing_sessions")).withColumn("k_", F.lit(0)), "k_").drop("k_")  # one row each


def missing_sessions(rows: DataFrame, keys: Sequence[str], day: str, calendar: DataFrame) -> DataFrame:
    """Sessions between each key's first and last session on which it has no row: a span per gap, then its sessions, without an anti-join."""
    numbers = rows.select(*keys, F.col(day).alias("session_date")).distinct().join(calendar.select("session_date", "session_no"), "session_date")
    following = F.lead("session_no").over(Window.partitionBy(*keys).orderBy("session_no"))
    gaps = numbers.withColumn("next", following).where("next > session_no + 1")
    missing = gaps.select(*keys, F.explode(F.sequence(F.col("session_no") + 1, F.col("next") - 1)).alias("session_no"))
    return missing.join(calendar.select("session_no", "session_date"), "session_no").select(*keys, "session_date")


def fact_issues(facts: DataFrame) -> DataFrame:
    """Issue rows of facts: value missing, no filing or acceptance, acceptance on a day before the filing's, units that differ in one metric."""
    units = facts.groupBy("metric_name_canonical").agg((F.count_distinct(F.lower("metric_unit")) > 1).alias("mixed"))
    checked = facts.join(units, "metric_name_canonical")
    raised = F.array_compact(F.array(
        F.when(F.col("metric_value").isNull(), F.lit("unparseable_value")),
        F.when(F.col("filing_date").isNull() & F.col("acceptance_datetime").isNull(), F.lit("missing_availability")),
        F.when(F.col("acceptance_datetime").cast("date") < F.col("filing_date"), F.lit("acceptance_before_filing")),
        F.when(F.col("mixed"), F.lit("inconsistent_units")),
    ))
    return checked.select("fact_id", "security_id", F.explode(raised).alias("issue"))


def first_failing(rules: Sequence[tuple[str, object]]):
    """The code of the first rule that does not hold, null included, in order; null where all hold."""
    out = None
    for code, rule in rules:
        failed = ~F.coalesce(rule, F.lit(False))
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return out

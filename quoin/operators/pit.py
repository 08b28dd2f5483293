"""Point-in-time joins by union and last-value windows: one shuffle by entity, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_intervals(facts: DataFrame, keys: Sequence[str], known: str) -> DataFrame:
    """Facts with available_to, the start of the next fact of the same keys, and is_latest."""
    order = Window.partitionBy(*keys).orderBy(known)
    return facts.withColumn("available_to", F.lead(known).over(order)).withColumn("is_latest", F.col("available_to").isNull())


def asof_metrics(panel: DataFrame, facts: DataFrame, key: str, as_of: str, metrics: Sequence[str], *, metric: str, value: str, known: str, until: str) -> DataFrame:
    """Each panel row with, per metric m, m, source_available_from__m and staleness_days__m of the latest fact known at ``as_of`` (an
    exact match counts); all null where there is none or it has ended by then. The newest fact decides, even if an older one still runs.
    A null value of that fact stays null with its source. Panel columns must not be named like the result's. Panel and facts go through one
    exchange, and the result is laid out by ``key``: exact duplicates of panel rows come out as such and can be dropped there."""
    own = [c for c in panel.columns if c != key]
    fact = F.struct(F.col(known).alias("known"), F.col(until).alias("until"), F.col(value).alias("value"))
    left = panel.select(key, F.struct(*own).alias("row"), F.col(as_of).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("m"))
    right = facts.where(F.col(metric).isin(list(metrics)) & F.col(known).isNotNull()).select(key, F.col(known).alias("t"), F.lit(0).alias("side"), F.col(metric).alias("m"), fact.alias("fact"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(key)
    order = Window.partitionBy(key).orderBy("t", "side", F.col("fact.until").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("m") == m, F.col("fact")), ignorenulls=True).over(order).alias(f"f_{m}") for m in metrics]
    found = both.select(key, "row", "t", "side", *latest).where("side = 1")
    out = [F.col(key), F.col("row.*")]
    for m in metrics:
        alive = F.col("t").isNotNull() & (F.col(f"f_{m}.until").isNull() | (F.col("t") < F.col(f"f_{m}.until")))
        out.append(F.when(alive, F.col(f"f_{m}.value")).alias(m))
        out.append(F.when(alive, F.col(f"f_{m}.known")).alias(f"source_available_from__{m}"))
        out.append(F.when(alive, F.date_diff(F.col("t").cast("date"), F.col(f"f_{m}.known").cast("date"))).alias(f"staleness_days__{m}"))
    return found.select(*out)


def coverage(panel: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric_name, rows, present, coverage) of each metric column."""
    n = F.count(F.lit(1))
    one = panel.agg(n.alias("rows"), *(F.count(m).alias(m) for m in metrics))
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).alias("present")) for m in metrics)))
    return one.select("rows", cells.alias("c")).select("c.metric_name", "rows", "c.present", (F.col("c.present") / F.greatest("rows", F.lit(1))).alias("coverage"))


def from_the_future(panel: DataFrame, as_of: str, metrics: Sequence[str]) -> DataFrame:
    """(metric_name, violations): panel rows whose source became known after ``as_of``; zero everywhere or the panel leaks."""
    late = {m: F.count_if(F.col(f"source_available_from__{m}") > F.col(as_of)) for m in metrics}
    one = panel.agg(*(c.alias(m) for m, c in late.items()))
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).alias("violations")) for m in metrics)))
    return one.select(cells.alias("c")).select("c.*")


def asof_lookup(facts: DataFrame, key: str, entity, metric: str, name: str, at, *, value: str, known: str, until: str) -> dict | None:
    """The fact of one entity and metric known at a time: a point query whose filters reach the scan. None if there is none or it has ended."""
    rows = facts.where((F.col(key) == F.lit(entity)) & (F.col(metric) == F.lit(name)) & (F.col(known) <= F.lit(at)))
    row = rows.agg(F.max_by(F.struct(value, known, until), known).alias("f")).first()["f"]
    if row is None or (row[until] is not None and at >= row[until]):
        return None
    return row.asDict()

"""Rolling totals over trailing periods, days without activity included.

Method: rows are aggregated per entity and day, densified to one row per entity and calendar day, and summed by window frames of
a fixed number of preceding rows. The grid is the product of entities and calendar, but no cross join makes it: every row generates
the days up to the next one of its entity, inside the partition that the window needs anyway. So only aggregated rows are
shuffled, and an entity's group is at most the calendar, however many rows it has. Rows that lie by entity already are not moved at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_days(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], calendar: DataFrame, calendar_day: str, calendar_no: str, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per entity and calendar day: keys, day_no, and for each value v: v__sum and v__n (non-null values), null and 0 on
    days without any; and the aggregates ``carry`` of the day's rows, null on days without. The calendar numbers its days from 1 without gaps and must be short (it is counted first)."""
    last = calendar.agg(F.max(calendar_no)).first()[0] or 0
    days = calendar.select(F.col(calendar_day).alias("c_day"), F.col(calendar_no).cast("int").alias("day_no"))
    carry = dict(carry or {})
    rows = df.withColumn("c_day", F.col(day))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    measures = [f(v).alias(f"{v}__{name}") for v in values for name, f in (("sum", F.sum), ("n", F.count))]
    daily = rows.groupBy(*keys, "c_day").agg(*measures, *(c.alias(n) for n, c in carry.items())).join(days, "c_day", "left").drop("c_day")
    # rows on no calendar day only say that the entity exists: all of them begin at day 1 and are real on none
    daily = daily.withColumn("day_no", F.coalesce("day_no", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("day_no")
    spans = daily.withColumns({"nth": F.row_number().over(order), "until": F.coalesce(F.lead("day_no").over(order), F.lit(last + 1)) - 1})
    begin = F.when(F.col("nth") == 1, F.lit(1)).otherwise(F.greatest("day_no", F.lit(1)))
    spans = spans.withColumn("from", begin).where(F.col("from") <= F.col("until"))
    grid = spans.withColumn("grid_no", F.explode(F.sequence("from", "until")))
    real = F.col("grid_no") == F.col("day_no")
    return grid.select(
        *keys, F.col("grid_no").alias("day_no"),
        *(F.when(real, F.col(f"{v}__sum")).alias(f"{v}__sum") for v in values),
        *(F.when(real, F.col(f"{v}__n")).otherwise(F.lit(0)).alias(f"{v}__n") for v in values),
        *(F.when(real, F.col(n)).alias(n) for n in carry),
    )


def trailing_totals(grid: DataFrame, keys: Sequence[str], frames: Mapping[str, Sequence[int]]) -> DataFrame:
    """``grid`` of dense_days with, for each value v and length k in ``frames``: v_sum_k, the total over the k days that end
    here (0 if there was nothing), and v_n_k, the number of values in it. Near the start the frame is what there is."""
    out = {}
    for v, lengths in frames.items():
        for k in lengths:
            frame = Window.partitionBy(*keys).orderBy("day_no").rowsBetween(1 - k, 0)
            out[f"{v}_sum_{k}"] = F.coalesce(F.sum(f"{v}__sum").over(frame), F.lit(0).cast(grid.schema[f"{v}__sum"].dataType))
            out[f"{v}_n_{k}"] = F.sum(f"{v}__n").over(frame)
    return grid.select("*", *(c.alias(n) for n, c in out.items()))


def rolling(df: DataFrame, keys: Sequence[str], day: str, calendar: DataFrame, calendar_day: str, calendar_no: str, frames: Mapping[str, Sequence[int]], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Totals per entity and calendar day over trailing periods; see dense_days and trailing_totals.

    Rows of one entity and day are added up, so repeated rows must be removed first where they are copies. Rows with a null key are
    left out; rows whose day is null or not in the calendar count for no day, but their entity gets its rows. Null values add nothing;
    NaN counts as a value. ``carry``: aggregates of a day's rows that its grid row keeps. Extra columns are ignored. An empty table gives an empty result, as does an empty calendar.
    """
    grid = dense_days(df, keys, day, list(frames), calendar, calendar_day, calendar_no, carry)
    return trailing_totals(grid, keys, frames)

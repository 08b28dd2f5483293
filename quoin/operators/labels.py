"""Forward labels: open to open, from the session after the decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import by_date, div, lag, pct_rank, quantile_bucket

HORIZONS = (1, 5, 10, 20)


def residuals(panel: DataFrame, beta: str, names: Mapping[str, str]) -> DataFrame:
    """``names``: label -> result. Each is the residual of a per-date least-squares fit of the label on a constant, beta (null as 0) and sector dummies (null a
    sector of its own), in closed form: both are demeaned within date and sector, then one slope per date. A date of one value keeps the label.
    All labels share two windows."""
    group, day = Window.partitionBy("date", "sector"), Window.partitionBy("date")
    centred, out = {}, {}
    for i, (y, name) in enumerate(names.items()):
        ok = F.col(y).isNotNull()
        x = F.when(ok, F.coalesce(beta, F.lit(0.0)))
        centred |= {f"y{i}_": F.col(y) - F.avg(y).over(group), f"x{i}_": x - F.avg(x).over(group)}
        xx, xy = F.sum(F.col(f"x{i}_") * F.col(f"x{i}_")).over(day), F.sum(F.col(f"x{i}_") * F.col(f"y{i}_")).over(day)
        slope = F.when(xx > 1e-18, xy / xx).otherwise(0.0)
        value = F.when(F.count(y).over(day) < 2, F.col(y)).otherwise(F.col(f"y{i}_") - slope * F.col(f"x{i}_"))
        out[name] = F.when(ok, value)
    return panel.withColumns(centred).withColumns(out).drop(*centred)


def forward_labels(panel: DataFrame, benchmark: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """``panel`` (security_id, date, open, sector, beta_estimate) with label_raw, label_excess, label_resid, label_binary and label_multiclass
    per horizon h. Leads count rows of the security; a label is null where its rows are missing. The result is laid out by date."""
    days = Window.orderBy("trade_date")  # one row a day
    bench = benchmark.select(F.col("trade_date").alias("date"), *((div(F.lead("open", h + 1).over(days), F.lead("open", 1).over(days)) - 1).alias(f"b_{h}") for h in horizons))
    out = panel.withColumns({f"label_raw_{h}d_oo": div(lag("open", -(h + 1)), lag("open", -1)) - 1 for h in horizons}).join(bench, "date", "left")
    out = out.withColumns({f"label_excess_{h}d_oo": F.col(f"label_raw_{h}d_oo") - F.col(f"b_{h}") for h in horizons}).drop(*(f"b_{h}" for h in horizons))
    out = residuals(by_date(out), "beta_estimate", {f"label_excess_{h}d_oo": f"label_resid_{h}d_oo" for h in horizons})
    ranks = {h: pct_rank(f"label_excess_{h}d_oo", "date") for h in horizons}
    out = out.withColumns({f"label_binary_top_bottom_{h}d": F.when(r >= 0.9, 1).when(r <= 0.1, 0) for h, r in ranks.items()})
    return out.withColumns({f"label_multiclass_quantile_{h}d": quantile_bucket(f"label_excess_{h}d_oo", 5, "date") for h in horizons})


def sanity(panel: DataFrame, labels: Sequence[str]) -> DataFrame:
    """rows, non_null, mean and population deviation of each label."""
    one = panel.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{i}") for c in labels for i, f in enumerate((F.count, F.avg, F.stddev_pop))))
    cells = F.array(*(F.struct(F.lit(c).alias("label"), F.col("n").alias("rows"), F.col(f"{c}_0").alias("non_null"), F.col(f"{c}_1").alias("mean"), F.col(f"{c}_2").alias("std")) for c in labels))
    return one.select(F.explode(cells).alias("c")).select("c.*")


def gold(features: DataFrame, labels: DataFrame | None, label: str) -> DataFrame:
    """Features left-joined with ``labels``, with row_valid_flag and the first reason a row is dropped for. Without ``labels`` the features have
    the label already, as they do where both were made on one panel, and nothing is joined."""
    out = features if labels is None else features.join(labels, ["date", "security_id"], "left")
    inside = F.coalesce("in_universe", F.lit(False))
    reason = F.when(~inside, "not_in_universe").when(F.col(label).isNull(), "missing_label")
    return out.withColumns({"row_valid_flag": inside & F.col(label).isNotNull(), "row_drop_reason": reason})

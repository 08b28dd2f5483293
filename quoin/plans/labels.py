"""Label and preprocessing queries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.expr import by_date, grid
from quoin.operators.features import with_membership, with_price_features
from quoin.operators.labels import HORIZONS, forward_labels, gold, sanity
from quoin.operators.preprocess import Winsorizer, beta_neutral, percentile_rank, robust_zscore, sector_neutral, zscore
from quoin.plans.base import benchmark, grid_sql, market, sectors
from quoin.plans.features import PRICE_CTE
from quoin.session import cut, table

CONTINUOUS = [f"label_{k}_{h}d_oo" for k in ("raw", "excess", "resid") for h in HORIZONS]
CLASSES = [f"label_{k}_{h}d" for k in ("binary_top_bottom", "multiclass_quantile") for h in HORIZONS]
#: Training rows of the preprocessing queries end before this day.
TRAIN_END = "2022-07-01"


def feature_base(spark: SparkSession, sf_dir: str, wanted: Collection[str] | None = None) -> DataFrame:
    """Market rows with price features, or the ``wanted`` ones, and the last sector."""
    return with_price_features(market(spark, sf_dir), benchmark(spark, sf_dir), wanted).join(sectors(spark, sf_dir), "security_id", "left")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = feature_base(spark, sf_dir, {"beta_estimate"}).select("security_id", "date", "open", "sector", "beta_estimate")
    return forward_labels(base, benchmark(spark, sf_dir))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(labels(spark, sf_dir).select("security_id", "date", *(grid(c).alias(c) for c in CONTINUOUS)))


def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(labels(spark, sf_dir).select("security_id", "date", *CLASSES))


def label_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanity(labels(spark, sf_dir), CONTINUOUS).select("label", "rows", "non_null", grid("mean").alias("mean"), grid("std").alias("std"))


def gold_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the gold panel by the reason they drop out for."""
    own = labels(spark, sf_dir).select("security_id", "date", "label_excess_5d_oo")
    panel = gold(with_membership(own, table(spark, sf_dir, "universe_snapshot")), None, "label_excess_5d_oo")
    return panel.groupBy("row_valid_flag", "row_drop_reason").agg(F.count(F.lit(1)).alias("rows"))


def _prepared(op):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = by_date(feature_base(spark, sf_dir, {"beta_estimate", "ret_5"}).select("security_id", "date", "sector", "beta_estimate", "ret_5"))
        return _day(op(base).select("security_id", "date", grid("x").alias("x")))

    return query


def _winsorize(base: DataFrame) -> DataFrame:
    base = cut(base)  # read by each pass of the fit
    return Winsorizer(["ret_5"], 0.01, 0.99).fit(base.where(F.col("date") < TRAIN_END)).transform(base).withColumn("x", F.col("ret_5"))


def _sector_beta(base: DataFrame) -> DataFrame:
    return base.withColumn("s", sector_neutral("ret_5")).withColumn("x", beta_neutral("s", "beta_estimate"))


QUERIES = {
    "label_values": label_values, "label_classes": label_classes, "label_sanity": label_sanity, "gold_drop_reasons": gold_drop_reasons,
    "prep_winsorize": _prepared(_winsorize), "prep_zscore": _prepared(lambda b: b.withColumn("x", zscore("ret_5"))),
    "prep_robust_zscore": _prepared(lambda b: robust_zscore(b, "ret_5", "x")), "prep_pct_rank": _prepared(lambda b: b.withColumn("x", percentile_rank("ret_5"))),
    "prep_sector_neutral": _prepared(lambda b: b.withColumn("x", sector_neutral("ret_5"))), "prep_beta_neutral": _prepared(lambda b: b.withColumn("x", beta_neutral("ret_5", "beta_estimate"))),
    "prep_sector_plus_beta": _prepared(_sector_beta),
}

_W = "PARTITION BY security_id ORDER BY date"
_L1 = ", ".join(f"lead(open, {h + 1}) OVER ({_W}) / lead(open, 1) OVER ({_W}) - 1 AS label_raw_{h}d_oo" for h in HORIZONS)
_LB = ", ".join(f"lead(open, {h + 1}) OVER (ORDER BY date) / lead(open, 1) OVER (ORDER BY date) - 1 AS b_{h}" for h in HORIZONS)
_DEV = ", ".join(
    f"CASE WHEN label_excess_{h}d_oo IS NOT NULL THEN label_excess_{h}d_oo - avg(label_excess_{h}d_oo) OVER (PARTITION BY date, sector) END AS y_{h}, "
    f"CASE WHEN label_excess_{h}d_oo IS NOT NULL THEN coalesce(beta_estimate, 0) - avg(CASE WHEN label_excess_{h}d_oo IS NOT NULL THEN coalesce(beta_estimate, 0) END) OVER (PARTITION BY date, sector) END AS x_{h}"
    for h in HORIZONS
)
_RES = ", ".join(
    f"""CASE WHEN label_excess_{h}d_oo IS NULL THEN NULL WHEN count(label_excess_{h}d_oo) OVER (PARTITION BY date) < 2 THEN label_excess_{h}d_oo
  WHEN sum(x_{h} * x_{h}) OVER (PARTITION BY date) > 1e-18 THEN y_{h} - sum(x_{h} * y_{h}) OVER (PARTITION BY date) / sum(x_{h} * x_{h}) OVER (PARTITION BY date) * x_{h} ELSE y_{h} END AS label_resid_{h}d_oo"""
    for h in HORIZONS
)


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY date)"


_CLASSES = ", ".join(
    f"CASE WHEN label_excess_{h}d_oo IS NULL THEN NULL WHEN {_rank_sql(f'label_excess_{h}d_oo')} >= 0.9 THEN 1 WHEN {_rank_sql(f'label_excess_{h}d_oo')} <= 0.1 THEN 0 END AS label_binary_top_bottom_{h}d, "
    f"CASE WHEN label_excess_{h}d_oo IS NOT NULL AND count(label_excess_{h}d_oo) OVER (PARTITION BY date) >= 5 THEN greatest(ceil(5.0::DOUBLE * (row_number() OVER (PARTITION BY date, label_excess_{h}d_oo IS NULL "
    f"ORDER BY label_excess_{h}d_oo, security_id) - 1) / (count(label_excess_{h}d_oo) OVER (PARTITION BY date) - 1)) - 1, 0)::INT END AS label_multiclass_quantile_{h}d"
    for h in HORIZONS
)
LABEL_CTE = (
    PRICE_CTE
    + f""",\nfb AS (SELECT px.*, sx.sector FROM px LEFT JOIN sx USING (security_id)), lb AS (SELECT date, {_LB} FROM bm),
l1 AS (SELECT security_id, date, sector, beta_estimate, {_L1} FROM fb),
l2 AS (SELECT l1.*, {', '.join(f'label_raw_{h}d_oo - b_{h} AS label_excess_{h}d_oo' for h in HORIZONS)} FROM l1 LEFT JOIN lb USING (date)),
l3 AS (SELECT *, {_DEV} FROM l2), ll AS (SELECT *, {_RES}, {_CLASSES} FROM l3)"""
)
_HEAD = "SELECT security_id, strftime(date, '%Y-%m-%d') AS date, "
_FEATURES = f"WITH {PRICE_CTE}, fb AS (SELECT px.security_id, px.date, px.ret_5, px.beta_estimate, sx.sector FROM px LEFT JOIN sx USING (security_id))"


def _prep_sql(ctes: str, x: str, source: str = "fb") -> str:
    return f"{_FEATURES}{ctes} {_HEAD}{grid_sql(x)} AS x FROM {source}"


def _beta_sql(c: str, source: str) -> str:
    ok = f"({c} IS NOT NULL AND beta_estimate IS NOT NULL)"
    return f""", bn0 AS (SELECT *, CASE WHEN {ok} THEN beta_estimate END AS bx, CASE WHEN {ok} THEN {c} END AS by_ FROM {source}),
bn AS (SELECT *, var_pop(bx) OVER d AS v, covar_pop(bx, by_) OVER d AS cv, avg(bx) OVER d AS mx, avg(by_) OVER d AS my, count(bx) OVER d AS n FROM bn0 WINDOW d AS (PARTITION BY date)),
bo AS (SELECT *, CASE WHEN bx IS NOT NULL AND n >= 2 THEN by_ - my - (CASE WHEN v > 1e-18 THEN cv / v ELSE 0 END) * (bx - mx) ELSE {c} END AS x FROM bn)"""


def _z(c: str, centre: str, spread: str) -> str:
    return f"CASE WHEN ({spread}) > 0 THEN ({c} - ({centre})) / ({spread}) ELSE {c} * 0.0 END"


_SECTOR = "ret_5 - avg(ret_5) OVER (PARTITION BY date, sector)"
SQL = {
    "label_values": f"WITH {LABEL_CTE} {_HEAD}{', '.join(f'{grid_sql(c)} AS {c}' for c in CONTINUOUS)} FROM ll",
    "label_classes": f"WITH {LABEL_CTE} {_HEAD}{', '.join(CLASSES)} FROM ll",
    "label_sanity": f"WITH {LABEL_CTE} "
    + " UNION ALL ".join(f"SELECT '{c}' AS label, count(*) AS rows, count({c}) AS non_null, {grid_sql(f'avg({c})')} AS mean, {grid_sql(f'stddev_pop({c})')} AS std FROM ll" for c in CONTINUOUS),
    "gold_drop_reasons": f"""WITH {LABEL_CTE}, gd AS (SELECT coalesce(in_universe, false) AS inside, label_excess_5d_oo AS y FROM ll LEFT JOIN un USING (date, security_id))
SELECT inside AND y IS NOT NULL AS row_valid_flag, CASE WHEN NOT inside THEN 'not_in_universe' WHEN y IS NULL THEN 'missing_label' END AS row_drop_reason, count(*) AS rows FROM gd GROUP BY 1, 2""",
    "prep_winsorize": _prep_sql(
        f", q AS (SELECT quantile_cont(ret_5, 0.01) lo, quantile_cont(ret_5, 0.99) hi FROM fb WHERE date < DATE '{TRAIN_END}')", "CASE WHEN ret_5 IS NOT NULL THEN least(greatest(ret_5, lo), hi) END", "fb, q"
    ),
    "prep_zscore": _prep_sql("", _z("ret_5", "avg(ret_5) OVER (PARTITION BY date)", "stddev_pop(ret_5) OVER (PARTITION BY date)")),
    "prep_robust_zscore": _prep_sql(
        ", m AS (SELECT *, median(ret_5) OVER (PARTITION BY date) AS md FROM fb), s AS (SELECT *, 1.4826::DOUBLE * median(abs(ret_5 - md)) OVER (PARTITION BY date) AS sp FROM m)", _z("ret_5", "md", "sp"), "s"
    ),
    "prep_pct_rank": _prep_sql("", f"CASE WHEN ret_5 IS NOT NULL THEN {_rank_sql('ret_5')} END"),
    "prep_sector_neutral": _prep_sql("", _SECTOR),
    "prep_beta_neutral": _prep_sql(_beta_sql("ret_5", "fb"), "x", "bo"),
    "prep_sector_plus_beta": _prep_sql(f", sn AS (SELECT *, {_SECTOR} AS s FROM fb)" + _beta_sql("s", "sn"), "x", "bo"),
}

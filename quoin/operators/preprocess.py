"""Cross-sectional preprocessing. Winsor bounds are the only fitted state; everything else is a window by date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.expr import pct_rank
from quoin.operators.quantiles import exact_quantiles

MAD = 1.4826


def day(*more: str) -> Window:
    return Window.partitionBy("date", *more)


def _scaled(x: Column, centre: Column, spread: Column) -> Column:
    """Null inputs stay null; without spread the score is zero."""
    return F.when(spread > 0, (x - centre) / spread).otherwise(x * 0.0)


def zscore(c: str) -> Column:
    return _scaled(F.col(c), F.avg(c).over(day()), F.stddev_pop(c).over(day()))


def robust_zscore(panel: DataFrame, c: str, out: str) -> DataFrame:
    """By median and scaled median absolute deviation; two passes over the same exchange."""
    staged = panel.withColumn("m_", F.median(c).over(day()))
    staged = staged.withColumn("s_", MAD * F.median(F.abs(F.col(c) - F.col("m_"))).over(day()))
    return staged.withColumn(out, _scaled(F.col(c), F.col("m_"), F.col("s_"))).drop("m_", "s_")


def percentile_rank(c: str) -> Column:
    return pct_rank(c, "date")


def sector_neutral(c: str) -> Column:
    return F.col(c) - F.avg(c).over(day("sector"))


def beta_neutral(c: str, beta: str) -> Column:
    """Residual of a per-date fit on a constant and beta; rows without beta, and dates of one pair, keep their value."""
    ok = F.col(c).isNotNull() & F.col(beta).isNotNull()
    x, y = F.when(ok, F.col(beta)), F.when(ok, F.col(c))
    variance, n = F.var_pop(x).over(day()), F.count(x).over(day())
    slope = F.when(variance > 1e-18, F.covar_pop(x, y).over(day()) / variance).otherwise(0.0)
    return F.when(ok & (n >= 2), y - F.avg(y).over(day()) - slope * (x - F.avg(x).over(day()))).otherwise(F.col(c))


@dataclass
class Winsorizer:
    """Clips to quantiles of the fit rows; fractions, not percents. Exact percentiles, linearly interpolated."""

    columns: Sequence[str]
    low: float = 0.005
    high: float = 0.995
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Winsorizer:
        if not 0 <= self.low < self.high <= 1:
            raise ValueError("quantiles must be ordered fractions")
        found = exact_quantiles(train, list(self.columns), [self.low, self.high])
        self.bounds = {c: tuple(v) for c, v in found.items() if v}
        return self

    def transform(self, panel: DataFrame) -> DataFrame:
        return panel.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in self.bounds.items()})


@dataclass
class FoldSafePreprocessor:
    """Winsorize, then scale, then neutralize; fitted on training rows alone, and it remembers which those were."""

    columns: Sequence[str]
    winsor: tuple[float, float] | None = (0.005, 0.995)
    scaler: str = "zscore"
    neutralizer: str = "none"
    fitted: dict = field(default_factory=dict)
    _winsorizer: Winsorizer | None = None

    def fit(self, train: DataFrame) -> FoldSafePreprocessor:
        if self.winsor:
            self._winsorizer = Winsorizer(self.columns, *self.winsor).fit(train)
        mark = F.xxhash64("date", "security_id", *self.columns)  # whatever the order of rows
        one = train.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.bit_xor(mark).alias("signature")).first()
        self.fitted = one.asDict() | {"columns": list(self.columns)}
        return self

    def require_train_only(self, first_test_date) -> None:
        if self.fitted and self.fitted["last"] is not None and self.fitted["last"] >= first_test_date:
            raise ValueError("the preprocessor was fitted on rows of the test period")

    def transform(self, panel: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit first")
        out = self._winsorizer.transform(panel) if self._winsorizer else panel
        for c in self.columns:
            if self.scaler == "robust_zscore":
                out = robust_zscore(out, c, c)
            elif self.scaler != "none":
                out = out.withColumn(c, {"zscore": zscore, "percentile_rank": percentile_rank}[self.scaler](c))
            if self.neutralizer in ("sector", "sector_plus_beta"):
                out = out.withColumn(c, sector_neutral(c))
            if self.neutralizer in ("beta", "sector_plus_beta"):
                out = out.withColumn(c, beta_neutral(c, "beta_estimate"))
        return out

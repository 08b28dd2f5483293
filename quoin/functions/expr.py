"""Column expressions shared by the panel operators. All are built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, DATE = "security_id", "date"


def by_security() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(DATE)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def lag(c: str | Column, k: int) -> Column:
    return (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(by_security())


def roll(f, c: str | Column, k: int, *, least: int | None = None, skip: int = 0) -> Column:
    """``f`` over the last k rows of the security, or those before the last ``skip``; null under ``least`` (default k) values."""
    frame = by_security().rowsBetween(1 - k - skip, -skip)
    return F.when(F.count(c).over(frame) >= (k if least is None else least), f(c).over(frame))


def log(c: str | Column) -> Column:
    """Natural logarithm; null unless positive."""
    return F.when(col(c) > 0, F.ln(c))


#: Beside one half, where sums of money often lie; engines that add in another order would fall on either side.
OFF_HALF = 0.51234


def grid(c: str | Column, places: int = 6, half: float = 0.5) -> Column:
    """Half-up on a decimal grid, by operations that every IEEE engine does alike; NaN becomes null."""
    scale = 10.0**places
    value = F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    return F.floor(value * scale + half).cast("double") / scale


def by_date(df: DataFrame) -> DataFrame:
    """``df`` laid out by date, for cross-sections: every window by date, or by date and more, then runs where the rows lie."""
    return df.repartition(DATE)


def pct_rank(c: str | Column, *by: str, mask: Column | None = None) -> Column:
    """Percentile rank with average ties among the non-null (and ``mask``ed) rows of each group; null elsewhere. Groups are those of ``by``
    alone, whatever the column: all ranks of a panel share one layout."""
    value = F.when(col(c).isNotNull() if mask is None else col(c).isNotNull() & mask, col(c))
    group = Window.partitionBy(*by)
    order = group.orderBy(value.asc_nulls_last())
    ties = F.count(value).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(order) + (ties - 1) / 2.0) / F.count(value).over(group))


def pct_rank_first(c: str | Column, *by: str, ties: str = KEY) -> Column:
    """Percentile rank with ties in the order of ``ties``."""
    group = Window.partitionBy(*by)
    return F.when(col(c).isNotNull(), F.row_number().over(group.orderBy(col(c).asc_nulls_last(), ties)) / F.count(col(c)).over(group))


def quantile_bucket(c: str | Column, buckets: int, *by: str, ties: str = KEY) -> Column:
    """Equal-width buckets of the ranks 1..n, 0-based; null in groups under ``buckets`` values. Not ntile, which fills from the front."""
    group = Window.partitionBy(*by)
    n, r = F.count(col(c)).over(group), F.row_number().over(group.orderBy(col(c).asc_nulls_last(), ties))
    return F.when(col(c).isNotNull() & (n >= buckets), F.greatest(F.ceil(buckets * (r - 1) / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0)).cast("int"))


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation of pairs, as an aggregate; null under two pairs or without variation, and never an error."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= 2) & (sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy))


#: Numerator and denominator of the rational approximation to the normal tail (Hart 1968), highest power first: fixed values.
TAIL = (
    (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def normal_cdf(x: str | Column) -> Column:
    """Distribution function of the standard normal, to fifteen digits up to seven deviations; 0 and 1 beyond."""
    a = F.abs(col(x))

    def polynomial(terms: tuple) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * a + F.lit(t)
        return out

    tail = F.when(a < 7.07106781186547, F.exp(-a * a / 2.0) * polynomial(TAIL[0]) / polynomial(TAIL[1])).otherwise(0.0)
    return F.when(col(x) > 0, 1.0 - tail).when(col(x).isNotNull(), tail)

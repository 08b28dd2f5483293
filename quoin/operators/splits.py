"""Purged and embargoed walk-forward folds, as one plan over the session list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WalkForward:
    """Lengths in months; ``horizon`` and ``embargo`` in sessions. ``expanding``: training always starts with the first month."""

    train: int
    valid: int
    test: int
    step: int = 1
    horizon: int = 5
    embargo: int = 5
    expanding: bool = False

    def __post_init__(self) -> None:
        if min(self.train, self.valid, self.test, self.step) < 1:
            raise ValueError("lengths and step are at least one month")


def fold_roles(sessions: DataFrame, spec: WalkForward) -> DataFrame:
    """fold, date, session_no, role (train, valid, test) and drop_reason (purged, embargoed or null) for session_date, session_no.

    Every session finds its folds by arithmetic on its month's number, so there is no join of folds and dates. A training session is
    purged if its label, ``horizon`` + 1 sessions on, reaches the fold's first validation session, and embargoed if it lies within ``embargo``
    sessions of it; validation likewise before the test. The boundary is that before anything is dropped.
    """
    span = spec.train + spec.valid + spec.test
    days = sessions.select(F.col("session_date").alias("date"), "session_no", F.date_format("session_date", "yyyy-MM").alias("month"))
    months = days.select("month").distinct().withColumn("m", F.row_number().over(Window.orderBy("month")) - 1)  # one row a month
    last = F.floor((F.max("m").over(Window.partitionBy()) + 1 - span) / spec.step)
    placed = days.join(months.withColumn("folds", last), "month")
    lowest = F.greatest(F.lit(0), F.ceil((F.col("m") - span + 1) / spec.step))
    highest = F.least(F.col("folds"), F.floor(F.col("m") / spec.step)) if not spec.expanding else F.col("folds")
    placed = placed.withColumns({"lo": lowest.cast("int"), "hi": highest.cast("int")}).where("lo <= hi").withColumn("fold", F.explode(F.sequence("lo", "hi")))
    at = F.col("m") - F.col("fold") * spec.step
    role = F.when(at < spec.train, "train").when(at < spec.train + spec.valid, "valid").when(at < span, "test")
    roles = placed.withColumn("role", role).where("role IS NOT NULL")
    fold = Window.partitionBy("fold")
    starts = {r: F.min(F.when(F.col("role") == r, F.col("session_no"))).over(fold) for r in ("valid", "test")}
    border = F.when(F.col("role") == "train", starts["valid"]).when(F.col("role") == "valid", starts["test"])
    left = border - F.col("session_no")
    reason = F.when(left <= spec.horizon + 1, "purged").when(left <= spec.embargo, "embargoed")
    return roles.withColumn("drop_reason", reason).select("fold", "date", "session_no", "role", "drop_reason")


def overlapping(roles: DataFrame) -> DataFrame:
    """(fold, date) with more than one role left; none in valid folds."""
    kept = roles.where("drop_reason IS NULL")
    return kept.groupBy("fold", "date").agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def fold_summary(roles: DataFrame) -> DataFrame:
    """Dates of each fold and role: first, last, kept and dropped."""
    n = F.count(F.lit(1))
    return roles.groupBy("fold", "role").agg(
        n.alias("dates"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason") == "purged").alias("purged"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def protocol(roles: DataFrame, spec: WalkForward, least: int = 0) -> DataFrame:
    """(fold, check, violations) of six checks on the rows of ``fold_roles`` that have no drop_reason: no date in two roles, at least ``least`` dates,
    labels that end before the next role, its distance beyond the embargo, roles one after the other, and training labels that end before
    validation and test. Boundaries are those before anything is dropped. All zero in a valid split."""
    fold = Window.partitionBy("fold")
    start = {r: F.min(F.when(F.col("role") == r, F.col("session_no"))).over(fold) for r in ("valid", "test")}
    rows = roles.withColumns({"v_": start["valid"], "t_": start["test"]}).where("drop_reason IS NULL")
    roles_of = rows.withColumn("times_", F.count(F.lit(1)).over(Window.partitionBy("fold", "date")))
    label_end = F.col("session_no") + 1 + spec.horizon
    train, valid = F.col("role") == "train", F.col("role") == "valid"
    last = lambda r: F.max(F.when(F.col("role") == r, F.col("session_no")))
    one = roles_of.groupBy("fold", "v_", "t_").agg(
        F.count_if(F.col("times_") > 1).alias("no_overlap"),
        (F.count(F.lit(1)) < least).cast("long").alias("min_sample_sizes"),
        F.count_if((train & (label_end >= F.col("v_"))) | (valid & (label_end >= F.col("t_")))).alias("purge_validity"),
        (F.coalesce((F.col("v_") - last("train") <= spec.embargo).cast("long"), F.lit(0)) + F.coalesce((F.col("t_") - last("valid") <= spec.embargo).cast("long"), F.lit(0))).alias("embargo_validity"),
        F.count_if((train & (F.col("session_no") >= F.col("v_"))) | (valid & (F.col("session_no") >= F.col("t_")))).alias("calendar_contiguity"),
        F.count_if(train & ((label_end >= F.col("v_")) | (label_end >= F.col("t_")))).alias("label_window_separation"),
    )
    names = ("no_overlap", "min_sample_sizes", "purge_validity", "embargo_validity", "calendar_contiguity", "label_window_separation")
    cells = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names))
    return one.select("fold", F.explode(cells).alias("c")).select("fold", "c.check", "c.violations")


def require_protocol(roles: DataFrame, spec: WalkForward, least: int = 0) -> None:
    """Raises on the first check that a fold breaks."""
    broken = protocol(roles, spec, least).where("violations > 0").orderBy("fold", "check").first()
    if broken is not None:
        raise ValueError(f"fold {broken['fold']} breaks {broken['check']}: {broken['violations']}")


def overlap_report(spec: WalkForward, purge: int | None = None) -> dict:
    """What overlapping labels of ``horizon`` sessions ask of a split, and what it has; ``purge`` is the label's reach unless given."""
    has = spec.horizon + 1 if purge is None else purge
    return {"primary_horizon": spec.horizon, "purge": has, "embargo": spec.embargo, "required_purge": spec.horizon, "required_embargo": spec.horizon, "enough": has >= spec.horizon and spec.embargo >= spec.horizon}


def segments(roles: DataFrame) -> tuple[list[tuple], list[frozenset]]:
    """Dates that play the same kept roles in the same folds make a segment: (date, segment) rows, and of each segment its (fold, role) pairs. What is summed by
    segment serves every fold. The roles, a session's folds times the sessions, are held on the driver."""
    own: dict = {}
    for r in roles.where("drop_reason IS NULL").select("date", "fold", "role").collect():
        own.setdefault(r["date"], set()).add((r["fold"], r["role"]))
    kinds: dict[frozenset, int] = {}
    dates = [(d, kinds.setdefault(frozenset(p), len(kinds))) for d, p in sorted(own.items())]
    return dates, list(kinds)

"""Trading calendar: a rule-based generator of New York sessions, and session arithmetic as joins on session numbers."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Full-day closures that follow no rule: fixed values.
CLOSURES = frozenset(
    map(date.fromisoformat, ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"))
)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last(year: int, month: int, weekday: int) -> date:
    end = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return end - timedelta(days=(end.weekday() - weekday) % 7)


def easter(year: int) -> date:
    """Easter Sunday, by the anonymous Gregorian computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    shift = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * shift) // 451
    month, day = divmod(h + shift - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _observed(day: date) -> date:
    return day - timedelta(days=1) if day.weekday() == 5 else day + timedelta(days=1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    out = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(days=2), _last(year, 5, 0), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 7, 4)), _observed(date(year, 12, 25))}
    if date(year, 1, 1).weekday() != 5:  # a Saturday New Year is not made up for
        out.add(_observed(date(year, 1, 1)))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return out


def half_days(year: int) -> set[date]:
    """Sessions that close at 13:00."""
    found = {_nth(year, 11, 3, 4) + timedelta(days=1), date(year, 12, 24)}
    if date(year, 7, 4).weekday() not in (5, 6, 0):
        found.add(date(year, 7, 3))
    return {d for d in found if d.weekday() < 5 and d not in holidays(year)}


def sessions(start: date, end: date) -> list[tuple[date, bool]]:
    """(session, is_half_day) from ``start`` to ``end``, both included."""
    years = range(start.year - 1, end.year + 2)
    closed = set().union(*map(holidays, years)) | CLOSURES
    short = set().union(*map(half_days, years))
    days = (start + timedelta(days=i) for i in range((end - start).days + 1))
    return [(d, d in short) for d in days if d.weekday() < 5 and d not in closed]


def calendar_frame(spark: SparkSession, start: date, end: date) -> DataFrame:
    """session_date, session_no from 1, is_half_day, open_utc, close_utc."""
    rows = [(d, i + 1, h) for i, (d, h) in enumerate(sessions(start, end))]
    days = spark.createDataFrame(rows, "session_date date, session_no int, is_half_day boolean")
    at = lambda h, m: F.to_utc_timestamp(F.col("session_date").cast("timestamp") + F.make_dt_interval(hours=F.lit(h), mins=F.lit(m)), ZONE)
    return days.withColumns({"open_utc": at(9, 30), "close_utc": F.when(F.col("is_half_day"), at(13, 0)).otherwise(at(16, 0))})


def day_numbers(calendar: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """``days`` with upto (sessions on or before ``day``) and is_session. The calendar is expanded to days, so the join is an equality; days
    before it have upto 0, days after its end all its sessions."""
    order = Window.orderBy("session_date")  # the calendar: one row a session
    spans = calendar.select("session_date", "session_no", F.lead("session_date").over(order).alias("next"))
    spans = spans.select("session_date", "session_no", F.coalesce(F.date_sub("next", 1), F.col("session_date")).alias("until"))
    filled = spans.select(F.explode(F.sequence("session_date", "until")).alias(day), F.col("session_no").alias("upto_"), F.col("session_date").alias("s_"))
    ends = calendar.agg(F.max("session_date").alias("last"), F.max("session_no").alias("n")).first()
    after = F.when(F.col(day) > F.lit(ends["last"]), F.lit(ends["n"] or 0)).when(F.col(day).isNotNull(), F.lit(0))
    joined = days.join(filled, day, "left")
    return joined.withColumns({"upto": F.coalesce("upto_", after), "is_session": F.when(F.col(day).isNotNull(), F.coalesce(F.col("s_") == F.col(day), F.lit(False)))}).drop("upto_", "s_")


def shift_sessions(calendar: DataFrame, days: DataFrame, day: str, steps: int, out: str) -> DataFrame:
    """``out``: the session ``steps`` sessions after ``day`` (before it, if negative), ``day`` itself never counting; null beyond the calendar."""
    numbered = day_numbers(calendar, days, day)
    base = F.col("upto") + steps if steps >= 0 else F.col("upto") + steps + F.when(F.col("is_session"), 0).otherwise(1)
    target = calendar.select(F.col("session_no").alias("n_"), F.col("session_date").alias(out))
    return numbered.withColumn("n_", base).join(target, "n_", "left").drop("n_", "upto", "is_session")


def session_distance(calendar: DataFrame, pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``out``: sessions in [a, b] less one, negated where b is before a; 0 for equal days. A start that is no session counts one less."""
    first = day_numbers(calendar, pairs, a).withColumns({"a_upto": F.col("upto"), "a_is": F.col("is_session")}).drop("upto", "is_session")
    both = day_numbers(calendar, first, b).withColumns({"b_upto": F.col("upto"), "b_is": F.col("is_session")}).drop("upto", "is_session")
    forward = F.col("b_upto") - F.col("a_upto") + F.col("a_is").cast("int") - 1
    backward = F.col("a_upto") - F.col("b_upto") + F.col("b_is").cast("int") - 1
    value = F.when(F.col(a) == F.col(b), 0).when(F.col(a) < F.col(b), forward).when(F.col(a) > F.col(b), -backward)
    return both.withColumn(out, value).drop("a_upto", "a_is", "b_upto", "b_is")


def window_by_sessions(calendar: DataFrame, end: date, lookback: int, include_end: bool = True) -> DataFrame:
    """The ``lookback`` sessions up to ``end``."""
    upto = F.col("session_date") <= F.lit(end) if include_end else F.col("session_date") < F.lit(end)
    return calendar.where(upto).orderBy(F.desc("session_no")).limit(lookback).orderBy("session_no")


def label_windows(calendar: DataFrame, horizon: int) -> DataFrame:
    """decision_date, execution_date (next session) and end_date (``horizon`` sessions on) of each session that has them."""
    order = Window.orderBy("session_no")
    out = calendar.select(F.col("session_date").alias("decision_date"), F.lead("session_date", 1).over(order).alias("execution_date"), F.lead("session_date", 1 + horizon).over(order).alias("end_date"))
    return out.where(F.col("end_date").isNotNull())


def same_bar(decision: str | Column, execution: str | Column) -> Column:
    """True where execution is not after the decision, or on the decision's own New York day."""
    d, e = (F.col(c) if isinstance(c, str) else c for c in (decision, execution))
    local = lambda t: F.from_utc_timestamp(t, ZONE).cast("date")
    return (e <= d) | (local(d) == local(e))


def require_no_same_bar(df: DataFrame, decision: str, execution: str) -> None:
    if not df.where(same_bar(decision, execution)).isEmpty():
        raise ValueError("execution on the bar of its decision")


def require_label_start(df: DataFrame, decision: str, start: str) -> None:
    """Raises if a label starts on its decision's day or before it; null days are not judged."""
    if not df.where(F.col(start) <= F.col(decision)).isEmpty():
        raise ValueError("a label starts before its decision can be executed")


def require_sessions(calendar: DataFrame, days: Iterable[date]) -> None:
    wanted = set(days)
    known = {r[0] for r in calendar.where(F.col("session_date").isin(list(wanted))).select("session_date").collect()} if wanted else set()
    if missing := wanted - known:
        raise ValueError(f"no sessions: {sorted(missing)}")

"""Wide tables, trailing totals, history, grid and spikes on small cases."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from quoin.operators.history import attribute_history
from quoin.operators.regular import impute, regular_grid
from quoin.operators.spikes import Rules, details, implausible, returning, scale
from quoin.operators.trailing import rolling
from quoin.operators.wide import BLOCK, cells_of, wide_by_position

D0 = date(2024, 1, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


# wide tables
WIDE = "e string, a string, v double, id long, o int, block string"
KINDS = {"x": "double", "n": "long", "b": "boolean"}


def wide(spark, rows):
    return wide_by_position(spark.createDataFrame([(*r, "z") for r in rows], WIDE), "e", "a", "v", "id", "o", KINDS)


def test_typed_cells_from_the_latest_row(spark):
    rows = [("p", "x", 1.5, 1, 1), ("p", "x", 2.5, 2, 2), ("p", "n", 7.0, 3, 1), ("p", "b", 1.0, 4, 1), ("q", "n", 7.5, 5, 1), ("q", "b", 2.0, 6, 1), ("q", "x", float("inf"), 7, 1)]
    got = {r["e"]: r for r in wide(spark, rows).collect()}
    assert (got["p"]["x"], got["p"]["n"], got["p"]["b"], got["p"]["x__id"]) == (2.5, 7, True, 2)
    assert got["q"]["n"] is None and got["q"]["n__id"] is None and got["q"]["b"] is None and got["q"]["x"] is None


def test_a_null_winner_empties_the_cell(spark):
    (row,) = wide(spark, [("p", "x", 1.0, 1, 1), ("p", "x", None, 2, 2)]).collect()
    assert row["x"] is None and row["x__id"] is None


def test_nulls_ties_repeats_strangers_and_empty(spark):
    rows = [("p", "x", 1.0, 1, 1), ("p", "x", 2.0, 2, 1), ("p", "x", 2.0, 2, 1), (None, "x", 1.0, 3, 1), ("q", None, 1.0, 4, 1), ("r", "other", 1.0, 5, 1), ("s", "x", 4.0, 6, None)]
    got = {r["e"]: r["x"] for r in wide(spark, rows).collect()}
    assert got == {"p": 2.0, "q": None, "r": None, "s": 4.0}
    assert wide(spark, []).count() == 0
    with pytest.raises(ValueError):
        wide_by_position(spark.createDataFrame([], WIDE), "e", "a", "v", "id", "o", {"e": "long"})


def test_ordinals_are_global_and_dense(spark):
    n = 2 * BLOCK + 100
    out = wide(spark, [(f"e{i:06d}", "n", float(i), i, 1) for i in range(n)]).select("e", "ordinal", "n").toPandas()
    assert sorted(out["ordinal"]) == list(range(n))
    assert (out["e"].str[1:].astype(int) == out["n"]).all()
    assert cells_of(wide(spark, [("p", "n", 3.0, 9, 1)]), "e", list(KINDS)).collect()[0]["id"] == 9


# trailing totals
def test_trailing_totals_count_days_without_rows(spark):
    cal = spark.createDataFrame([(day(i), i + 1) for i in range(10)], "d date, no int")
    rows = [("a", day(2), 5.0), ("a", day(2), 1.0), ("a", day(7), 2.0), ("a", day(7), None), ("b", day(40), 9.0), (None, day(1), 1.0), ("c", None, 1.0), ("c", day(0), None)]
    out = rolling(spark.createDataFrame([(*r, "x") for r in rows], "k string, day date, v double, day_no string"), ["k"], "day", cal, "d", "no", {"v": [3]}).collect()
    got = {(r["k"], r["day_no"]): (r["v_sum_3"], r["v_n_3"]) for r in out}
    assert len(got) == len(out) == 30
    for k, own in (("a", {2: (6.0, 2), 7: (2.0, 1)}), ("b", {}), ("c", {})):
        for no in range(1, 11):
            window = [own[d] for d in own if no - 3 <= d <= no - 1]
            assert got[k, no] == (sum(v for v, _ in window), sum(n for _, n in window)), (k, no)
    assert rolling(spark.createDataFrame([], "k string, day date, v double"), ["k"], "day", cal, "d", "no", {"v": [3]}).count() == 0


def test_several_days_outside_the_calendar_count_for_none(spark):
    cal = spark.createDataFrame([(day(i), i + 1) for i in range(5)], "d date, no int")
    rows = [("a", day(20), 5.0), ("a", day(21), 7.0), ("a", None, 9.0), ("a", day(2), 1.0), ("b", day(20), 5.0), ("b", None, 9.0)]
    out = rolling(spark.createDataFrame(rows, "k string, day date, v double"), ["k"], "day", cal, "d", "no", {"v": [3]}).collect()
    a = {no: (1.0, 1) if no >= 3 else (0.0, 0) for no in range(1, 6)}
    assert sorted((r["k"], r["day_no"], r["v_sum_3"], r["v_n_3"]) for r in out) == [("a", no, *a[no]) for no in a] + [("b", no, 0.0, 0) for no in a]


# history
HISTORY = "k string, t date, loaded timestamp, s string, d string, valid_from int"


def history(spark, rows):
    frame = spark.createDataFrame([(k, day(t), datetime(2024, 1, 1) + timedelta(hours=h), s, d, 1) for k, t, h, s, d in rows], HISTORY)
    return sorted((r["k"], (r["valid_from"] - D0).days, r["valid_to"] and (r["valid_to"] - D0).days, r["s"], r["d"]) for r in attribute_history(frame, ["k"], "t", "loaded", ["s"], ["d"]).collect())


def test_versions_close_on_change(spark):
    rows = [("a", 0, 0, "x", None), ("a", 1, 0, None, None), ("a", 2, 0, "y", None), ("a", 3, 0, "x", None), ("a", 4, 0, "x", "z"), ("a", 5, 0, "x", None)]
    assert history(spark, rows) == [("a", 0, 2, "x", None), ("a", 2, 3, "y", None), ("a", 3, 4, "x", None), ("a", 4, 5, "x", "z"), ("a", 5, None, "x", None)]


def test_the_last_delivery_counts_and_bad_rows_do_not(spark):
    rows = [("a", 0, 1, "x", None), ("a", 0, 5, "y", None), ("a", 0, 5, "y", None), (None, 0, 0, "q", None), ("a", None, 0, "q", None), ("b", 3, 0, None, None), ("b", 4, 0, "w", None)]
    assert history(spark, rows) == [("a", 0, None, "y", None), ("b", 3, 4, None, None), ("b", 4, None, "w", None)]
    assert history(spark, []) == []


def test_several_sources_are_merged(spark):
    one = spark.createDataFrame([("a", day(0), datetime(2024, 1, 1), "x", None, 1)], HISTORY)
    two = spark.createDataFrame([("a", day(9), datetime(2024, 1, 1), "y", None, 1)], HISTORY)
    assert attribute_history([one, two], ["k"], "t", "loaded", ["s"], ["d"]).count() == 2


# grid
def test_imputation_beats_carrying_forward_on_held_out_values():
    rng = np.random.default_rng(1)
    t = np.arange(400)
    x = 4 + 0.002 * t + 0.05 * np.sin(t / 7) + 0.03 * np.cos(t / 3) + 0.002 * rng.standard_normal(400)
    holes = np.sort(rng.choice(np.arange(5, 395), 80, replace=False))
    holed = x.copy()
    holed[holes] = np.nan
    filled = impute(holed)
    carried = holed.copy()
    for i in holes:
        carried[i] = carried[i - 1]
    error = lambda y: math.sqrt(float(np.mean((y[holes] - x[holes]) ** 2)))
    assert error(filled) < 0.35 * error(carried)
    assert np.array_equal(np.delete(filled, holes), np.delete(x, holes))


def test_short_constant_and_whole_series():
    assert impute(np.array([1.0, np.nan, 3.0])).tolist() == [1.0, 2.0, 3.0]
    assert impute(np.array([2.0, np.nan, np.nan, 2.0] * 5))[1] == 2.0
    assert impute(np.array([5.0])).tolist() == [5.0]


def test_grid_marks_what_it_fills(spark):
    cal = spark.createDataFrame([(day(i), i + 1) for i in range(8)], "d date, no int")
    rows = [("a", day(1), 1.0, 1), ("a", day(1), 3.0, 2), ("a", day(4), 6.0, 1), ("a", day(5), None, 1), ("a", day(20), 9.0, 1), (None, day(1), 1.0, 1), ("b", None, 1.0, 1), ("c", day(2), float("nan"), 1), ("d", day(3), -1.0, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "k string, day date, v double, o int, status string")
    out = {(r["k"], r["slot"]): (r["status"], r["value"]) for r in regular_grid(frame, ["k"], "day", "v", ["o"], cal, "d", "no").collect()}
    assert len(out) == 16
    assert out["a", 2] == ("observed", 3.0) and out["a", 5] == ("observed", 6.0)
    assert [out["a", s][0] for s in (3, 4)] == ["filled"] * 2 and 3.0 < out["a", 3][1] < out["a", 4][1] < 6.0
    assert out["a", 1] == ("outside", None) and out["a", 6] == ("outside", None) and out["d", 4] == ("observed", -1.0)
    assert regular_grid(frame.limit(0), ["k"], "day", "v", ["o"], cal, "d", "no").count() == 0


# spikes
RULES = Rules(spiky=("c", "v"), sticky=("c",), active="v", positive=("c",), nonnegative=("v",), within=(("c", "lo", "hi"),))
SPIKES = "k string, day date, c double, lo double, hi double, v long, ver string, id long, at string, reasons string"


def flagged(spark, rows):
    frame = spark.createDataFrame([(k, day(d), c, c if c is None else c * 0.99, c if c is None else c * 1.01, v, ver, i, "x", "y") for i, (k, d, c, v, ver) in enumerate(rows)], SPIKES)
    return {r["id"]: sorted(r["reasons"]) for r in implausible(frame, ["k"], "day", "c", ["ver", "id"], RULES, ["id"]).collect()}


def series(n=80, seed=1):
    rng = random.Random(seed)
    c, out = 100.0, []
    for d in range(n):
        c *= math.exp(rng.gauss(0, 0.01))
        out.append(["a", d, c, int(1e5 * math.exp(rng.gauss(0, 0.3))), "v1"])
    return out


def test_spikes_of_one_and_of_three_days(spark):
    rows = series()
    rows[20][2] *= 1.4
    for d in (50, 51, 52):
        rows[d][2] *= 0.6
    rows[60][3] *= 500
    assert flagged(spark, rows) == {20: ["spike:c"], 50: ["spike:c"], 51: ["spike:c"], 52: ["spike:c"], 60: ["spike:v"]}


def test_lasting_moves_and_busy_days_are_none(spark):
    rows = series()
    for r in rows[40:]:
        r[2] *= 0.5
    rows[10][3] *= 8
    assert flagged(spark, rows) == {}


def test_a_correction_is_judged_by_its_own_values(spark):
    rows = series()
    good = list(rows[30])
    rows[30][2] *= 1.5
    again = list(rows[30])
    good[4] = "v2"
    assert flagged(spark, [*rows, good, again]) == {30: ["spike:c"], 81: ["spike:c"]}


def test_stuck_runs_but_not_without_activity(spark):
    rows = series()
    for d in range(31, 36):
        rows[d][2] = rows[30][2]
    for d in range(51, 56):
        rows[d][2], rows[d][3] = rows[50][2], 0
    assert flagged(spark, rows) == {d: ["stuck:c"] for d in range(31, 36)}


def test_impossible_readings_nulls_and_empty(spark):
    rows = series(30)
    rows[5][2], rows[9][3], rows[12][2], rows[13][3] = -1.0, -5, None, None
    rows += [[None, 3, 5.0, 1, "v1"], ["a", None, 5.0, 1, "v1"], ["b", 1, 7.0, 1, "v1"], ["b", 2, 7.0, 1, "v1"]]
    got = flagged(spark, rows)
    assert got[5] == ["impossible"] and got[9] == ["impossible"] and set(got) == {5, 9}
    assert flagged(spark, []) == {}


def test_details_see_a_step_at_its_place():
    x = np.array([0.0] * 10 + [1.0] * 10)
    assert np.flatnonzero(details(x, 1)).tolist() == [9]
    assert not returning(np.zeros(3), 0.1).any() and not returning(x, 0.1).any() and scale(np.zeros(4)) == 0.0


def test_the_pair_of_details_decides(spark, monkeypatch):
    x = np.zeros(20)
    x[8], x[10] = 3.0, 3.0  # two spikes with a right value between them
    assert np.flatnonzero(returning(x, 1.0)).tolist() == [8, 10]
    x[9] = 2.5
    assert np.flatnonzero(returning(x, 1.0)).tolist() == [8, 9, 10]
    rows = series()
    rows[20][2] *= 1.4
    monkeypatch.setattr("quoin.operators.spikes.details", lambda x, level: np.zeros(len(x) - 1))  # no transform, no spike
    from quoin.operators.spikes import _spikes

    assert not _spikes(np.arange(80), np.arange(80), np.array([r[2] for r in rows])).any()


@pytest.mark.parametrize("most", [0, 50_000])
def test_every_delivery_of_a_reading_comes_out(spark, monkeypatch, most):
    monkeypatch.setattr("quoin.operators.spikes.BROADCAST", most)
    rows = series()
    rows[20][2] *= 1.4
    rows[60][2] *= 1.4
    rows += [list(rows[20]) for _ in range(4)] + [list(rows[60])]
    assert flagged(spark, rows) == {i: ["spike:c"] for i in (20, 60, 80, 81, 82, 83, 84)}


def test_claims_long_after_and_before_the_calendar(spark, tmp_path):
    from quoin.plans.p5_trailing import p5_found

    cal = [(day(i), i + 1) for i in range(30)]
    spark.createDataFrame(cal, "session_date date, session_no int").write.parquet(f"{tmp_path}/trading_calendar.parquet")
    spark.createDataFrame([("a", day(i), 20.0) for i in range(30)], "security_id string, trade_date date, dollar_volume double").write.parquet(f"{tmp_path}/silver_market.parquet")
    claims = [("a", day(29), 20.0), ("a", day(200), 20.0), ("a", day(201), 30.0), ("a", day(-3), 0.0), ("a", day(-4), 1.0), ("a", day(0), 1.0), ("a", day(1), 1.0), ("b", day(5), 2.0), ("b", day(6), 0.0), ("a", day(29), 20.0)]
    spark.createDataFrame(claims, "security_id string, date date, adv20_usd_t double").write.parquet(f"{tmp_path}/universe_snapshot.parquet")
    got = sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect())
    assert got == sorted([("a", str(day(201))), ("a", str(day(-4))), ("a", str(day(1))), ("b", str(day(5)))])

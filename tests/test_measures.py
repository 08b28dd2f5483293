"""Quantiles, products, protocols, uncertainty and allocation against brute force and by hand."""

import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions.expr import normal_cdf
from quoin.operators.evaluate import GATES, deflated_sharpe, portfolio_uncertainty, predictive_uncertainty, stability_gates, wide_predictions
from quoin.operators.models import BOOSTING, boosting_candidates, gram, gram_of, segment_products
from quoin.operators.normalize import cik, normalize_actions, normalize_market, normalize_master, require_intervals
from quoin.operators.portfolio import backtest, capped_weights, portfolio_inputs, water_fill
from quoin.operators.quantiles import exact_quantiles
from quoin.operators.splits import WalkForward, fold_roles, overlap_report, protocol, require_protocol, segments


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_are_exact_whatever_the_bracket(spark, monkeypatch, accuracy):
    monkeypatch.setattr("quoin.operators.quantiles.ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal(3000), rng.integers(0, 5, 3000).astype(float)
    rows = [(float(a), float(b), None) for a, b in zip(x, y)] + [(None, math.nan, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    at = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], at)
    assert np.allclose(got["a"], np.quantile(x, at)) and np.allclose(got["b"], np.quantile(y, at)) and got["c"] is None
    for n in (1, 2, 3, 7):
        assert np.allclose(exact_quantiles(df.limit(n), ["a"], at)["a"], np.quantile([r[0] for r in df.limit(n).collect()], at))
    assert exact_quantiles(df.limit(0), ["a"], at) == {"a": None}
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [1.5])


def test_products_do_not_cancel_and_segments_add_up(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 3)) + 1e8  # far from zero: sums of squares would lose every digit
    rows = [(*map(float, r), i % 4) for i, r in enumerate(x)] + [(None, 1.0, 1.0, 0), (1.0, 1.0, math.nan, 0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double, s int").repartition(5)
    parts = segment_products(df, ["a", "b"], "y", "s")
    g = gram_of(list(parts.values()), ["a", "b"])
    c = x - x.mean(axis=0)
    assert g.n == 900 and np.allclose(g.xx, c[:, :2].T @ c[:, :2], rtol=1e-6) and np.allclose(g.xy, c[:, :2].T @ c[:, 2], atol=1e-4)
    own = x[1::4] - x[1::4].mean(axis=0)
    assert np.allclose(parts[1][2], own.T @ own, rtol=1e-6, atol=1e-4)
    assert gram(df.where("s IS NOT NULL"), ["a", "b"], "y").n == 900


def test_normal_distribution(spark):
    xs = [-9.0, -3.1, -0.5, 0.0, 1.7, 6.5, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf("x")).collect()]
    assert got[-1] is None and all(abs(g - NormalDist().cdf(x)) < 1e-14 for g, x in zip(got, xs[:-1]))


def roles_of(spark, spec, n=500):
    days = [(date(2020, 1, 1) + timedelta(days=i), i + 1) for i in range(n)]
    return fold_roles(spark.createDataFrame(days, "session_date date, session_no int"), spec)


def test_protocol_holds_and_finds_what_is_broken(spark):
    spec = WalkForward(train=4, valid=2, test=1, step=3, horizon=5, embargo=9)
    roles = roles_of(spark, spec)
    require_protocol(roles, spec, 100)
    broken = {r["check"] for r in protocol(roles.withColumn("drop_reason", F.lit(None).cast("string")), spec, 10_000).where("violations > 0").collect()}
    assert broken == {"min_sample_sizes", "purge_validity", "embargo_validity", "label_window_separation"}
    twice = roles.unionByName(roles.where("role = 'valid'").withColumn("role", F.lit("train")))
    assert {r["check"] for r in protocol(twice, spec).where("violations > 0").collect()} >= {"no_overlap", "calendar_contiguity"}
    with pytest.raises(ValueError):
        require_protocol(twice, spec)
    assert overlap_report(spec)["enough"] and not overlap_report(spec, 3)["enough"]
    dates, kinds = segments(roles)
    kept = roles.where("drop_reason IS NULL").collect()
    assert {(d, f, r) for d, i in dates for f, r in kinds[i]} == {(r["date"], r["fold"], r["role"]) for r in kept} and len(kinds) < len(dates) / 5


def test_uncertainty_and_gates():
    rng = np.random.default_rng(0)
    good, noise = rng.normal(0.05, 0.1, 400), rng.normal(0.0, 0.1, 400)
    one = predictive_uncertainty([*good, None, math.nan], good)
    assert one["rank_ic_ci_lower"] < one["rank_ic_mean"] < one["rank_ic_ci_upper"] and one["rank_ic_p_value"] < 1e-6 and one["sample_size_days"] == 400
    assert predictive_uncertainty(noise, noise)["rank_ic_p_value"] > 1e-4
    assert predictive_uncertainty([], [])["rank_ic_mean"] is None
    own = portfolio_uncertainty(good / 100, trials=20)
    assert own["net_sharpe_ci_lower"] < own["net_sharpe"] < own["net_sharpe_ci_upper"] and own["deflated_sharpe_ratio"] <= own["probabilistic_sharpe_ratio"]
    assert portfolio_uncertainty([0.0] * 5)["net_sharpe"] is None and portfolio_uncertainty([]) == {}
    assert deflated_sharpe(0.1, 250, 0.0, 3.0, 20) < deflated_sharpe(0.1, 250, 0.0, 3.0, 1)
    rows = {r["gate"]: r for r in stability_gates({"predictive_floor": -0.5, "capacity_clip": 0.1}, 1.0, -0.2)}
    assert len(rows) == len(GATES) + 1 == 7
    assert not rows["predictive_floor"]["passed"] and rows["capacity_clip"]["passed"] and rows["deflated_sharpe"]["passed"]
    assert not rows["cost_robustness"]["passed"] and rows["cost_robustness"]["threshold"] == 0.0
    assert stability_gates({}, None, None)[-1]["passed"]


def test_normalisation(spark):
    master = spark.createDataFrame([("s1", "AA"), ("s2", "BB"), ("s3", "bb "), ("s4", None)], "security_id string, symbol string")
    rows = spark.createDataFrame([(" aa", 1.0), ("bb", 2.0), ("zz", 3.0), (None, 4.0)], "symbol string, close double")
    assert [tuple(r) for r in normalize_market(rows, master, "p", "v").select("symbol", "security_id", "close", "provider_name", "data_version").collect()] == [("AA", "s1", 1.0, "p", "v")]
    actions = spark.createDataFrame(
        [(None, "aa", None, None, "Split ", "2024-01-02", None, "2", "x"), (None, None, "aa", "cc", "dividend", "bad", None, None, "0.5"), ("s9", "zz", None, None, "merger", None, None, None, None), (None, "bb", None, None, "split", None, None, None, None)],
        "security_id string, symbol string, old_symbol string, new_symbol string, event_type string, event_date string, effective_date string, split_ratio string, dividend_amount string",
    )
    got = [tuple(r) for r in normalize_actions(actions, master, "v").select("security_id", "event_type", "event_date", "split_ratio", "dividend_amount", "new_symbol", "problem").collect()]
    assert sorted(got, key=str) == sorted([("s1", "split", date(2024, 1, 2), 2.0, None, None, None), ("s1", "dividend", None, None, 0.5, "CC", None), ("s9", "merger", None, None, None, None, "unknown_type"), (None, "split", None, None, None, None, "unmapped_security")], key=str)
    bad = spark.createDataFrame([("s1", "a", "nyse", "ETF", date(2024, 1, 2), date(2024, 1, 1))], "security_id string, symbol string, exchange string, security_type string, listing_date date, delisting_date date")
    with pytest.raises(ValueError):
        require_intervals(normalize_master(bad))
    assert require_intervals(normalize_master(bad.withColumn("delisting_date", F.lit(None).cast("date")))).first()["exchange"] == "NYSE"
    ids = spark.createDataFrame([("CIK 12",), ("123456789012",), ("none",), (None,)], "c string").select(cik("c")).collect()
    assert [r[0] for r in ids] == ["0000000012", "123456789012", None, None]


def test_inputs_come_from_the_first_that_knows(spark):
    d = date(2024, 1, 1)
    preds = spark.createDataFrame([(d, "a", "m", 1.0), (d, "b", "m", 2.0)], "date date, security_id string, model_name string, raw_prediction double")
    universe = spark.createDataFrame([(d, "a", "low", None)], "date date, security_id string, bucket string, adv double")
    panel = spark.createDataFrame([(d, "a", "high", 5.0), (d, "b", "mid", 6.0)], "date date, security_id string, bucket string, adv double")
    assert sorted(tuple(r) for r in portfolio_inputs(preds, universe, panel).select("security_id", "bucket", "adv").collect()) == [("a", "low", 5.0), ("b", "mid", 6.0)]
    with pytest.raises(ValueError):
        portfolio_inputs(preds.unionByName(preds.withColumn("model_name", F.lit("n"))), universe, panel)
    wide = wide_predictions(preds.unionByName(preds.where("security_id = 'a'").withColumn("model_name", F.lit("n"))), ["m", "n"]).collect()
    assert sorted(tuple(r)[1:] for r in wide) == [("a", 1.0, 1.0), ("b", 2.0, None)]


def test_water_is_filled_under_caps(spark):
    weight, refused = water_fill(np.array(list("abcd")), ["x", "x", "y", "y"], 1, 1.0, 0.4, 0.5, 1.0, {}, {})
    assert weight.tolist() == [0.25] * 4 and not refused.any()
    weight, _ = water_fill(np.array(list("abc")), ["x", "x", "y"], 1, 1.0, 0.6, 0.5, 1.0, {}, {})
    assert np.allclose(weight, [1 / 3, 1 / 6, 1 / 2]) and weight[:2].sum() <= 0.5 + 1e-12  # the group's cap stops b; what is left goes to c
    weight, refused = water_fill(np.array(list("ab")), ["x", "x"], -1, 1.0, 0.3, 1.0, 0.25, {}, {})
    assert np.allclose(weight.sum(), -0.25) and refused[1]
    rng = random.Random(2)
    rows = [(date(2024, 1, d), f"s{i}", 1 if i < 6 else -1, rng.random(), "xyz"[i % 3] if i % 5 else None) for d in (1, 2) for i in range(12)]
    out = capped_weights(spark.createDataFrame(rows, "date date, security_id string, side int, score double, sector string"), name_cap=0.12, group_gross=0.4, group_net=0.1).toPandas()
    sector = {r[1]: r[4] for r in rows}
    for _, day in out.groupby("date"):
        assert day["weight"].abs().max() <= 0.12 + 1e-9 and day["weight"].abs().sum() <= 1 + 1e-9
        for g in ("x", "y", "z", None):
            own = day[[sector[s] == g for s in day["security_id"]]]["weight"]
            assert own.abs().sum() <= 0.4 + 1e-9 and abs(own.sum()) <= 0.1 + 1e-9


def test_backtests_of_many_scenarios_scan_each_alone(spark):
    rng = random.Random(5)
    rows = [(date(2024, 1, 1) + timedelta(days=d), f"s{i}", rng.uniform(-0.2, 0.2), rng.uniform(-0.05, 0.05), rng.choice([1e4, 1e6, None])) for d in range(12) for i in range(8) if rng.random() < 0.8]
    days = spark.createDataFrame(rows, "date date, security_id string, weight double, day_return double, capacity double")
    given = [(f"x{i}", rng.choice([0.1, 1.0]), rng.choice([0.0, 0.002]), 1.0 + i) for i in range(8)]
    scenarios = spark.createDataFrame(given, "scenario string, participation double, cost_rate double, aum_multiple double")
    got = {(r["scenario"], r["date"]): (r["aum"], r["turnover"], r["clipped"]) for r in backtest(days, scenarios).collect()}
    assert len(got) == 8 * len({r[0] for r in rows})
    for name, most, rate, multiple in given:
        aum, held = 1e6 * multiple, {}
        for d in sorted({r[0] for r in rows}):
            day = [r for r in rows if r[0] == d]
            done, traded, clipped, now = {}, 0.0, 0, {}
            for _, s, w, _, cap in day:
                wanted = (w - held.get(s, 0.0)) * aum
                done[s] = math.copysign(min(abs(wanted), (cap or 0.0) * most), wanted)
                clipped += abs(done[s]) < abs(wanted) * 0.999999
                now[s] = held.get(s, 0.0) + done[s] / aum
                traded += abs(done[s])
            traded += sum(abs(w) for s, w in held.items() if s not in now) * aum
            gross = sum(now[r[1]] * aum * r[3] for r in day)
            turnover, aum, held = traded / aum, aum + gross - traded * rate, now
            assert got[name, d] == pytest.approx((aum, turnover, clipped / len(day)))
    assert backtest(days, scenarios.limit(0)).count() == 0


def test_boosting_search_is_seeded():
    assert len(boosting_candidates(50)) == 24 == math.prod(map(len, BOOSTING.values())) and len(boosting_candidates()) == 16
    assert boosting_candidates(3, 7) == boosting_candidates(3, 7) and len(boosting_candidates(0)) == 1

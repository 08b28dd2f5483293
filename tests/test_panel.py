import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.config import Config
from quoin.operators.calendar import easter, half_days, holidays, require_no_same_bar, sessions
from quoin.operators.evaluate import block_bootstrap, deflated_sharpe, drawdown_of, gates, one_sided_p, probabilistic_sharpe
from quoin.operators.models import BoostedStumps, LinearModel, elastic_net, gram, grid_of, ridge, some_of, tune
from quoin.operators.portfolio import backtest, constrained_weights, project
from quoin.operators.preprocess import FoldSafePreprocessor
from quoin.operators.quality import first_failing
from quoin.operators.splits import WalkForward, fold_roles, overlapping
from quoin.plans.base import calendar
from quoin.plans.evaluation import SPEC, boosted_scores
from quoin.streaming.ingest import append_batches, latest_versions
from quoin.streaming.intervals import stream_periods


def test_calendar_rules_give_the_given_sessions(spark, data):
    rows = calendar(spark, data).orderBy("session_date").collect()
    own = dict(sessions(date(2021, 1, 4), date(2023, 12, 29)))
    assert own.pop(date(2021, 12, 31)) is False  # the table closes for the New Year of a Saturday, the exchange did not
    given = {r["session_date"]: r["is_half_day"] for r in rows}
    assert set(own) == set(given)
    assert {d for d in own if own[d] != given[d]} <= {date(2023, 7, 3)}  # a half day that the table leaves out
    assert easter(2024) == date(2024, 3, 31) and date(2024, 3, 29) in holidays(2024) and date(2024, 7, 3) in half_days(2024)


def test_same_bar_is_refused(spark):
    rows = spark.sql("SELECT timestamp'2024-01-02 21:00:00' d, timestamp'2024-01-03 14:30:00' e")
    require_no_same_bar(rows, "d", "e")
    with pytest.raises(ValueError):
        require_no_same_bar(rows, "d", "d")


@pytest.mark.parametrize("expanding", [False, True])
def test_folds_keep_their_distance(spark, expanding):
    rng = random.Random(3)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(900) if rng.random() > 0.12]
    frame = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "session_date date, session_no int")
    spec = WalkForward(train=6, valid=2, test=1, step=2, horizon=5, embargo=8, expanding=expanding)
    roles = fold_roles(frame, spec)
    assert overlapping(roles).count() == 0
    kept = roles.where("drop_reason IS NULL").groupBy("fold", "role").agg(F.min("session_no").alias("a"), F.max("session_no").alias("b")).collect()
    by = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in kept}
    starts = {(r["fold"], r["role"]): r["a"] for r in roles.groupBy("fold", "role").agg(F.min("session_no").alias("a")).collect()}
    folds = {f for f, _ in by}
    assert len(folds) > 5
    for f in folds:
        assert by[f, "train"][1] + spec.horizon + 1 < starts[f, "valid"] and starts[f, "valid"] - by[f, "train"][1] > spec.embargo
        assert by[f, "valid"][1] + spec.horizon + 1 < starts[f, "test"]
        assert (by[f, "train"][0] == 1) == (expanding or f == 0)


@pytest.mark.parametrize("spec", [SPEC, Config().splits])
def test_every_session_after_the_first_span_is_tested_once(spark, data, spec):
    days = [r[0] for r in calendar(spark, data).select("session_date").orderBy("session_date").collect()]
    months = sorted({(d.year, d.month) for d in days})
    left = [d for d in days if (d.year, d.month) in months[spec.train + spec.valid :]]
    tested = fold_roles(calendar(spark, data), spec).where("role = 'test' AND drop_reason IS NULL").select("date").collect()
    assert sorted(r[0] for r in tested) == left


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = 0.7 * x[:, 0] - 0.3 * x[:, 1] + 0.1 * rng.standard_normal(n)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), x, y


def test_linear_models_match_numpy(spark):
    df, x, y = table(spark)
    g = gram(df, ["a", "b", "c"], "y")
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(ridge(g, 2.0).coefficients, np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc))
    lasso = elastic_net(g, 0.05)
    grad = xc.T @ (yc - xc @ np.array(lasso.coefficients)) / len(y)
    assert all(abs(gr - 0.05 * np.sign(c)) < 1e-4 if c else abs(gr) <= 0.05 + 1e-6 for gr, c in zip(grad, lasso.coefficients))
    assert lasso.coefficients[2] == 0.0
    again = LinearModel.from_json(ridge(g, 2.0).to_json())
    assert again == ridge(g, 2.0)
    with pytest.raises(ValueError):
        gram(df.limit(0), ["a"], "y")


def test_stumps_learn_and_do_not_see_row_order(spark):
    df, x, y = table(spark)
    one, two = (BoostedStumps(rounds=15, rate=0.3, keep=2).fit(d, ["a", "b", "c"], "y") for d in (df, df.repartition(5)))
    assert [s[:2] for s in one.splits] == [s[:2] for s in two.splits] and set(one.features) == {"a", "b"}
    one = BoostedStumps.from_json(one.to_json())
    got = df.where("y IS NOT NULL AND a IS NOT NULL").select(F.corr(one.predict(), "y")).first()[0]
    assert got > 0.85


def test_the_boosting_query_runs_all_rounds(spark, data, monkeypatch):
    rounds = []
    monkeypatch.setattr(BoostedStumps, "fit", lambda self, *_: rounds.append(self.rounds) or self)
    assert boosted_scores(spark, data).columns == ["security_id", "date", "score"] and rounds == [50]


def test_tuning_keeps_the_first_best():
    options = grid_of(a=[1, 2, 3], b=[0])
    assert tune(options, lambda p: p["a"], lambda m: min(m, 2)) == ({"a": 2, "b": 0}, 2)
    assert some_of(options, 2, 1) == some_of(options, 2, 1)


def test_preprocessing_is_fitted_on_training_rows_alone(spark):
    rows = [(date(2024, 1, d), f"s{i}", "x" if i % 2 else None, float(i), float(i * d)) for d in range(1, 9) for i in range(6)]
    df = spark.createDataFrame(rows, "date date, security_id string, sector string, beta_estimate double, f double")
    train = df.where("date < '2024-01-05'")
    fitted = FoldSafePreprocessor(["f"], (0.0, 0.9), "robust_zscore", "sector_plus_beta").fit(train)
    fitted.require_train_only(date(2024, 1, 5))
    with pytest.raises(ValueError):
        fitted.require_train_only(date(2024, 1, 4))
    changed = df.withColumn("f", F.when(F.col("date") >= "2024-01-05", F.col("f") * 1000).otherwise(F.col("f")))
    first = lambda d: sorted(map(tuple, fitted.transform(d).where("date < '2024-01-05'").select("security_id", "date", "f").collect()))
    assert first(df) == first(changed)


def test_statistics():
    assert one_sided_p(0.0, 1.0, 50) == pytest.approx(0.5) and one_sided_p(1.0, 0.0, 9) is None
    assert probabilistic_sharpe(0.1, 250, 0, 3) > deflated_sharpe(0.1, 250, 0, 3, 20, 0.05)
    draws = block_bootstrap(np.arange(100.0), np.mean, 50, 10, 7)
    assert len(draws) == 50 and np.array_equal(draws, block_bootstrap(np.arange(100.0), np.mean, 50, 10, 7)) and abs(draws.mean() - 49.5) < 5
    assert gates({"a": float("nan"), "b": 1.0}, {"a": (">=", 0), "b": ("<=", 0.5), "c": (">=", 1)}) == {"a": True, "b": False, "c": True}
    assert drawdown_of([0.5, -0.5]) == pytest.approx(-0.5)


def test_weights_keep_their_constraints(spark):
    rng = random.Random(1)
    rows = [(date(2024, 1, d), f"s{i:02d}", 1 if i < 10 else -1, rng.uniform(0.8, 1.2), "tech" if i % 2 else "oil") for d in (1, 2) for i in range(20)]
    out = constrained_weights(spark.createDataFrame(rows, "date date, security_id string, side int, beta_estimate double, sector string"), name_cap=0.2).toPandas()
    for date_, day in out.groupby("date"):
        meta = {r[1]: r for r in rows if r[0] == date_}
        w = day["weight"].to_numpy()
        assert abs(w.sum()) < 1e-6 and abs(np.abs(w).sum() - 1) < 1e-6 and np.abs(w).max() < 0.2 + 1e-9
        assert abs(sum(v * meta[s][3] for s, v in zip(day["security_id"], w))) < 1e-6
        assert abs(sum(v for s, v in zip(day["security_id"], w) if meta[s][4] == "oil")) < 1e-6
    assert np.allclose(project(np.array([1.0, 0.0]), np.array([[1.0, 1.0]]), np.array([1.0]), np.zeros(2), np.ones(2)), [1.0, 0.0])


def test_backtest_by_hand(spark):
    days = spark.createDataFrame([(date(2024, 1, 1), "a", 0.5, 0.1, 1e9), (date(2024, 1, 2), "a", 0.5, None, 1e9), (date(2024, 1, 3), "b", 1.0, 0.0, 1e5)], "date date, security_id string, weight double, day_return double, capacity double")
    scenarios = spark.createDataFrame([("x", 1.0, 0.001, 1.0)], "scenario string, participation double, cost_rate double, aum_multiple double")
    a, b, c = backtest(days, scenarios).orderBy("date").collect()
    assert a["gross_pnl"] == pytest.approx(5e4) and a["cost"] == pytest.approx(500) and a["aum"] == pytest.approx(1_049_500)
    assert b["gross_pnl"] == 0 and b["cost"] == 0
    assert c["clipped"] == 1.0 and c["turnover"] == pytest.approx((1e5 + 0.5 * 1_049_500) / 1_049_500)


def test_first_failing_rule(spark):
    df = spark.createDataFrame([(1, 5.0), (0, 5.0), (None, 5.0), (1, None)], "a int, b double")
    got = [r[0] for r in df.select(first_failing([("a", F.col("a") > 0), ("b", F.col("b") > 1)])).collect()]
    assert got == [None, "a", "a", "b"]


def test_streamed_periods_end_like_the_batch(spark, tmp_path):
    rows = [("a", 0, 4), ("a", 10, 12), ("b", 1, 2), ("a", 3, 10), ("a", 3, 10), (None, 1, 2), ("b", 5, None)]
    schema = "k string, s timestamp, e timestamp"
    at = lambda x: None if x is None else np.datetime64("2024-01-01").astype("M8[us]").item() + timedelta(hours=x)
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame([(k, at(s), at(e)) for k, s, e in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream_periods(stream, ["k"], "s", "e").writeStream.outputMode("update").foreachBatch(append_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    gone = {(r["k"], r["t_start"], r["t_end"]) for r in out if r["kind"] == "replaced"}
    live = {(r["k"], r["t_start"], r["t_end"]) for r in out if r["kind"] == "period"} - gone
    hour, base = 3_600_000_000, int(at(0).timestamp() - at(0).astimezone().utcoffset().total_seconds() * 0) * 1_000_000
    assert {(k, (s - base) // hour, (e - base) // hour if e < 2**62 else None) for k, s, e in live} == {("a", 0, 12), ("b", 1, 2), ("b", 5, None)}
    last = latest_versions(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string"), ["k"], ["o"]).collect()
    assert [tuple(r) for r in last] == [("a", 2, "y")]

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from quoin.__main__ import main
from quoin.config import Config, load_config
from quoin.config import Model as ModelSettings
from quoin.operators.evaluate import daily_ic
from quoin.operators.models import boosting_candidates
from quoin.operators.pit import asof_lookup
from quoin.operators.splits import WalkForward, fold_roles
from quoin.pipeline import STAGES, ablation, ablation_scenarios, by_tier, out_of_fold, registry_frame, run, verify
from quoin.sources.sinks import read_json


def test_the_pipeline_writes_every_stage(spark, data, tmp_path):
    out = str(tmp_path / "run")
    config = Config(splits=WalkForward(train=12, valid=3, test=3, step=9))
    assert run(spark, data, out, config) == list(STAGES)
    predictions = spark.read.parquet(f"{out}/predictions")
    assert predictions.count() == predictions.select("fold", "date", "security_id").distinct().count() > 0
    tests = spark.read.parquet(f"{out}/folds").where("role = 'test'")
    assert predictions.join(tests, ["fold", "date"], "left_anti").count() == 0
    assert spark.read.parquet(f"{out}/evaluation/summary").first()["days"] is not None
    made = read_json(spark, f"{out}/report.json")
    assert len(made["figures"]) == 12 and all(f.startswith("<svg") for f in made["figures"].values()) and made["markdown"].count("## ") == 20 == made["html"].count("<h2>")
    assert {g["gate"] for g in read_json(spark, f"{out}/evaluation/uncertainty.json")["gates"]} >= {"predictive_floor", "cost_robustness"}
    assert read_json(spark, f"{out}/config.json")["hash"] == config.hash and read_json(spark, f"{out}/gold.json")["dataset_id"].startswith("gold__v1__")
    verify(spark, out)
    spark.read.parquet(f"{out}/gold").limit(5).write.mode("overwrite").parquet(f"{out}/gold2")
    with pytest.raises(ValueError):
        verify(spark, out, {"gold": "gold2"})


@pytest.fixture(scope="module")
def small(spark):
    """Two years of a label that one feature makes, another disturbs."""
    rng = random.Random(1)
    days = [date(2021, 1, 4) + timedelta(days=i) for i in range(0, 720, 4)]
    rows = []
    for d in days:
        for i in range(12):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((d, f"s{i:02d}", "x" if i % 2 else "y", 1.0, a, b, 0.0, 0.0, 0.01 * (1 if a > 0 else -1) + 0.002 * rng.gauss(0, 1)))
    panel = spark.createDataFrame(rows, "date date, security_id string, sector string, beta_estimate double, ret_5 double, vol_21 double, rev_1 double, mom_21_ex1 double, y double").cache()
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "session_date date, session_no int")
    spec = WalkForward(train=9, valid=3, test=3, step=8, horizon=1, embargo=2)
    return panel, fold_roles(sessions, spec), Config(splits=spec, model=ModelSettings(features=("ret_5", "vol_21"), label="y", trials=2))


@pytest.mark.parametrize("name", ["boosted_ranker", "elastic_net", "random"])
def test_models_of_every_tier_score_out_of_fold(spark, small, name):
    panel, roles, config = small
    config = replace(config, model=replace(config.model, name=name, alphas=(1e-5, 1e-4), l1_ratios=(0.5,)))
    predictions, usage = out_of_fold(panel, roles, config)
    tests = roles.where("role = 'test' AND drop_reason IS NULL")
    assert predictions.count() == panel.join(tests, "date").count() > 0 and len(usage) == roles.select("fold").distinct().count()
    ic = daily_ic(predictions, "raw_prediction", "y").agg({"rank_ic": "avg"}).first()[0]
    assert ic > 0.5 if name != "random" else abs(ic) < 0.2
    if name == "boosted_ranker":
        assert all(len(u["tried"]) == 2 and u["params"] in boosting_candidates(2, 42) for u in usage)


def test_registry(spark):
    rows = registry_frame(spark).collect()
    assert len(rows) == 10 and [r["name"] for r in rows if r["tier"] == "boosting"] == ["boosted", "boosted_ranker"] == sorted(by_tier("boosting"))


def test_ablations_fit_again(spark, small):
    panel, roles, config = small
    names = [n for n, _ in ablation_scenarios(config)]
    assert names == ["all", "drop_returns", "drop_volatility", "no_winsor", "robust", "raw"] or set(names) == {"all", "drop_returns", "drop_volatility", "no_winsor", "robust", "raw"}
    short = replace(config, model=replace(config.model, alphas=(1.0,)))
    got = {r["scenario"]: r for r in ablation(panel, roles, short).collect()}
    assert got["all"]["rank_ic_mean_delta"] == 0 and got["drop_returns"]["rank_ic_mean_delta"] < -0.3 and abs(got["drop_volatility"]["rank_ic_mean_delta"]) < 0.1


def test_configs_merge_and_unknown_settings_fail(tmp_path):
    (tmp_path / "a.yaml").write_text("model:\n  name: lasso\n  alphas: [0.1]\nsplits:\n  train: 6\n")
    (tmp_path / "b.yaml").write_text("model:\n  alphas: [0.2, 0.3]\n")
    config, warnings = load_config([str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml")])
    assert (config.model.name, config.model.alphas, config.splits.train, config.splits.valid, warnings) == ("lasso", (0.2, 0.3), 6, 2, [])
    assert config.hash != Config().hash == Config().hash
    (tmp_path / "c.yaml").write_text("model:\n  colour: red\n")
    with pytest.raises(ValueError):
        load_config([str(tmp_path / "c.yaml")])
    assert load_config([str(tmp_path / "c.yaml")], strict=False)[1]


def test_dry_run_names_stages_without_spark(capsys):
    assert main(["run", "--data", "x", "--out", "y", "--until", "folds", "--dry-run"]) == 0
    assert '"stages": ["panel", "folds"]' in capsys.readouterr().out


def test_point_lookup(spark):
    t = [datetime(2024, 1, d) for d in range(1, 10)]
    facts = spark.createDataFrame([("a", "m", 1.0, t[0], t[3]), ("a", "m", 2.0, t[3], t[5]), ("b", "m", 9.0, t[0], None)], "k string, m string, v double, f timestamp, u timestamp")
    look = lambda at: asof_lookup(facts, "k", "a", "m", "m", at, value="v", known="f", until="u")
    assert look(t[3])["v"] == 2.0 and look(t[2])["v"] == 1.0 and look(t[6]) is None and look(datetime(2023, 1, 1)) is None

"""The panel pipeline: panel, labels, folds, out-of-fold scores, evaluation and report, as lazy plans with written tables between stages."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.config import Config, snapshot
from quoin.functions.expr import by_date, pct_rank_first
from quoin.operators.evaluate import (
    correlation_matrix, daily_ic, decay, decay_ends, deltas, equity_curve, fdr, hypotheses, portfolio_uncertainty, predictive_uncertainty, regimes, rolling_ic, sharpe, stability_gates,
)
from quoin.operators.features import FAMILIES
from quoin.operators.models import BoostedStumps, blend_score, boosting_candidates, decile, elastic_net, gram, grid_of, momentum_score, random_score, rank_target, reversal_score, ridge, tune
from quoin.operators.portfolio import backtest, capacity_table, cost_table, long_short
from quoin.operators.preprocess import FoldSafePreprocessor
from quoin.operators.splits import fold_roles, overlap_report, require_protocol
from quoin.plans.base import benchmark, calendar
from quoin.plans.evaluation import gold_rows
from quoin.session import cut
from quoin.sources.figures import bars, heat_map, lines
from quoin.sources.sinks import dataset_id, html_report, lineage, markdown, read_json, write_json, write_table

LOG = logging.getLogger("quoin")
STAGES = ("panel", "folds", "predictions", "evaluation", "report")


@dataclass(frozen=True)
class Model:
    """An entry of the registry: ``score`` needs no fit; ``prepare`` reads rows, features and target column once for all candidates, and ``fit`` makes of that
    and of parameters a model with ``predict``; ``candidates`` are the parameters to choose from; ``target`` transforms the label."""

    tier: str
    score: Callable[[], Column] | None = None
    prepare: Callable | None = None
    fit: Callable | None = None
    candidates: Callable[[Config], list[dict]] | None = None
    target: Callable[[str], Column] | None = None


def _stumps(prepared: tuple, params: dict) -> BoostedStumps:
    return BoostedStumps(**params).fit(*prepared)


def _rows(rows: DataFrame, features: Sequence[str], y: str) -> tuple:
    return cut(rows.select(*features, y)), features, y


def _alphas(config: Config) -> list[dict]:
    return [{"alpha": a} for a in config.model.alphas]


def _boosting(config: Config) -> list[dict]:
    return boosting_candidates(config.model.trials, config.model.seed)


REGISTRY: dict[str, Model] = {
    "random": Model("baseline", score=lambda: random_score(42)),
    "reversal": Model("baseline", score=reversal_score),
    "momentum": Model("baseline", score=momentum_score),
    "blend": Model("baseline", score=blend_score),
    "ridge": Model("linear", prepare=gram, fit=lambda g, p: ridge(g, **p), candidates=_alphas),
    "lasso": Model("linear", prepare=gram, fit=lambda g, p: elastic_net(g, **p), candidates=_alphas),
    "elastic_net": Model("linear", prepare=gram, fit=lambda g, p: elastic_net(g, **p), candidates=lambda c: grid_of(alpha=c.model.alphas, l1_ratio=c.model.l1_ratios)),
    "rank_ridge": Model("ranking", prepare=gram, fit=lambda g, p: ridge(g, **p), candidates=_alphas, target=rank_target),
    "boosted": Model("boosting", prepare=_rows, fit=_stumps, candidates=_boosting),
    "boosted_ranker": Model("boosting", prepare=_rows, fit=_stumps, candidates=_boosting, target=rank_target),
}


def registry_frame(spark: SparkSession) -> DataFrame:
    """name, tier, fitted, tuned and ranks of every model, by tier and name."""
    rows = [(n, m.tier, m.fit is not None, m.candidates is not None, m.target is not None) for n, m in REGISTRY.items()]
    return spark.createDataFrame(rows, "name string, tier string, fitted boolean, tuned boolean, ranks boolean").orderBy("tier", "name")


def by_tier(tier: str) -> list[str]:
    return [n for n, m in REGISTRY.items() if m.tier == tier]


def log_event(event: str, **values) -> None:
    """One JSON line a stage."""
    LOG.info(json.dumps({"event": event, "time": time.time(), **values}, sort_keys=True, default=str))


def out_of_fold(panel: DataFrame, roles: DataFrame, config: Config) -> tuple[DataFrame, list[dict]]:
    """(predictions, usage) over folds: the preprocessor sees training rows, parameters are chosen by mean rank IC on validation rows, the chosen model is
    fitted again on both, and only then are test rows scored. Scores that need no fit are those of the test rows. A fold that breaks the split's
    protocol raises."""
    require_protocol(roles, config.splits)
    own = REGISTRY[config.model.name]
    features, label = list(config.model.features), config.model.label
    kept = roles.where("drop_reason IS NULL")
    if own.score is not None:
        tests = kept.where("role = 'test'").select("date", "fold")
        out = panel.join(tests, "date").select("date", "security_id", "fold", own.score().alias("raw_prediction"), label)
        return _ranked(out, config), [{"fold": r[0]} for r in tests.select("fold").distinct().orderBy("fold").collect()]
    y = "target_"
    panel = panel.withColumn(y, own.target(label) if own.target else F.col(label))
    out, usage = None, []
    for fold in [r[0] for r in kept.select("fold").distinct().orderBy("fold").collect()]:  # tens of folds
        part = {r: panel.join(kept.where((F.col("fold") == fold) & (F.col("role") == r)).select("date"), "date") for r in ("train", "valid", "test")}
        prepared = FoldSafePreprocessor(features, config.preprocessing.winsor, config.preprocessing.scaler, config.preprocessing.neutralizer).fit(part["train"])
        ready = {r: prepared.transform(p) for r, p in part.items()}
        first_test = part["test"].agg(F.min("date")).first()[0]
        prepared.require_train_only(first_test)
        tried = []

        def score(model, valid: DataFrame = ready["valid"]) -> float | None:
            value = daily_ic(valid.withColumn("p_", model.predict()), "p_", label).agg(F.avg("rank_ic")).first()[0]
            tried.append(value)  # noqa: B023
            return value

        candidates = own.candidates(config)
        try:
            prepared_rows = own.prepare(ready["train"], features, y)
            params, valid_ic = tune(candidates, lambda p, r=prepared_rows: own.fit(r, p), score)
        except ValueError:  # too few validation rows for a rank IC: nothing to choose by
            params, valid_ic = candidates[0], None
        model = own.fit(own.prepare(ready["train"].unionByName(ready["valid"]), features, y), params)
        scores = ready["test"].select("date", "security_id", F.lit(fold).alias("fold"), model.predict().alias("raw_prediction"), label)
        usage.append({"fold": fold, "params": params, "valid_rank_ic": valid_ic, "tried": tried, "fit": prepared.fitted, "model": json.loads(model.to_json())})
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        raise ValueError("the sessions make no fold")
    return _ranked(out, config), usage


def _ranked(scores: DataFrame, config: Config) -> DataFrame:
    ranked = by_date(scores).withColumn("rank_prediction", pct_rank_first("raw_prediction", "fold", "date"))
    return ranked.withColumns({"bucket_prediction": decile("rank_prediction"), "model_name": F.lit(config.model.name), "config_hash": F.lit(config.hash)})


#: Name -> change of the preprocessing, for ablations.
PREPARATIONS = {"no_winsor": {"low_percent": 0.0, "high_percent": 100.0}, "robust": {"scaler": "robust_zscore"}, "raw": {"scaler": "none"}}


def ablation_scenarios(config: Config) -> list[tuple[str, Config]]:
    """(scenario, config): everything, each feature family dropped in turn, and each preparation of PREPARATIONS. Families without a feature in use, and
    scenarios that change nothing or leave no feature, are left out."""
    base = config.model.features
    out = [("all", config)]
    for family, names in FAMILIES.items():
        left = tuple(f for f in base if f not in names)
        if left and left != base:
            out.append((f"drop_{family}", replace(config, model=replace(config.model, features=left))))
    out += [(name, replace(config, preprocessing=replace(config.preprocessing, **change))) for name, change in PREPARATIONS.items()]
    unique: dict[str, tuple[str, Config]] = {}
    for name, c in out:
        unique.setdefault(c.hash, (name, c))
    return list(unique.values())


def ablation(panel: DataFrame, roles: DataFrame, config: Config) -> DataFrame:
    """(scenario, rank_ic_mean, days, rank_ic_mean_delta): each scenario fitted and scored anew on every fold, less the first."""
    out = None
    for i, (name, c) in enumerate(ablation_scenarios(config)):
        predictions, _ = out_of_fold(panel, roles, c)
        one = daily_ic(predictions, "raw_prediction", c.model.label).agg(F.avg("rank_ic").alias("rank_ic_mean"), F.count("rank_ic").alias("days")).withColumns({"scenario": F.lit(name), "n_": F.lit(i), "g_": F.lit(0)})
        out = one if out is None else out.unionByName(one)
    return deltas(out, "g_", "n_", "rank_ic_mean").select("scenario", "rank_ic_mean", "days", "rank_ic_mean_delta")


def run(spark: SparkSession, data: str, out: str, config: Config, until: str = "report", dry: bool = False) -> list[str]:
    """Run the stages up to ``until`` and return their names; ``dry`` only names them. Panel and predictions are written once and read
    again by what follows."""
    if until not in STAGES:
        raise ValueError(f"unknown stage {until}")
    stages = list(STAGES[: STAGES.index(until) + 1])
    if dry:
        return stages
    write_json(spark, f"{out}/config.json", snapshot(config))
    columns = [*dict.fromkeys([*config.model.features, config.model.label, "mom_21_ex1", "rev_1", "book_to_price", "adv20", "label_raw_1d_oo", *(f"label_excess_{h}d_oo" for h in HORIZONS)])]
    write_table(gold_rows(spark, data).select("date", "security_id", "sector", "beta_estimate", *columns), f"{out}/gold")
    panel = spark.read.parquet(f"{out}/gold")
    write_json(spark, f"{out}/gold.json", lineage(panel) | {"dataset_id": dataset_id("gold", "v1", panel)})
    log_event("panel", rows=panel.count())
    if until == "panel":
        return stages
    roles = fold_roles(calendar(spark, data), config.splits)
    write_table(roles, f"{out}/folds")
    roles = spark.read.parquet(f"{out}/folds")
    write_json(spark, f"{out}/overlap.json", overlap_report(config.splits))
    if until == "folds":
        return stages
    predictions, usage = out_of_fold(panel, roles, config)
    write_table(predictions, f"{out}/predictions")
    write_json(spark, f"{out}/usage.json", {"folds": usage, "config_hash": config.hash})
    predictions = spark.read.parquet(f"{out}/predictions")
    log_event("predictions", folds=len(usage))
    if until == "predictions":
        return stages
    evaluate(spark, data, out, config, panel, predictions)
    log_event("evaluation")
    if until == "report":
        report(spark, out, config)
    return stages


def verify(spark: SparkSession, out: str, tables: dict[str, str] | None = None) -> None:
    """Raises if a written table is not the one its manifest describes: rows, columns, content and schema. ``tables``: manifest -> table."""
    for manifest, name in (tables or {"gold": "gold"}).items():
        known, now = read_json(spark, f"{out}/{manifest}.json"), lineage(spark.read.parquet(f"{out}/{name}"))
        if wrong := [k for k, v in now.items() if known.get(k) != v]:
            raise ValueError(f"{name} differs from its manifest in {wrong}")


HORIZONS = (1, 5, 10, 20)
#: Cost scenario -> rate; AUM multiple x participation of the capacity ladder.
COSTS = {"free": 0.0, "base": 0.001, "stress": 0.003}
LADDER = [(a, p) for a in (1, 10, 100, 1000) for p in (0.02, 0.1)]


def evaluate(spark: SparkSession, data: str, out: str, config: Config, panel: DataFrame, predictions: DataFrame) -> None:
    """Writes the evaluation tables: ICs, regimes, decay, hypotheses, coverage, equity, costs, capacity, uncertainty and gates."""
    label = config.model.label
    put = lambda name, df: write_table(df, f"{out}/evaluation/{name}")
    get = lambda name: spark.read.parquet(f"{out}/evaluation/{name}")
    put("ic", rolling_ic(daily_ic(predictions, "raw_prediction", label)))
    joined = predictions.drop(label).join(panel, ["date", "security_id"])
    put("decay", decay(joined, "raw_prediction", {h: f"label_excess_{h}d_oo" for h in HORIZONS}))
    put("regimes", get("ic").join(regimes(benchmark(spark, data)), "date").groupBy("regime").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count(F.lit(1)).alias("dates")))
    put("hypotheses", fdr(hypotheses(get("ic").withColumns({"hypothesis": F.lit(config.model.name), "family": F.lit("model")}), "family", "hypothesis"), "family", "p", 0.1))
    put("coverage", panel.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), *((F.count(f) / F.count(F.lit(1))).alias(f) for f in config.model.features)))
    put("correlations", correlation_matrix(predictions.select("date", "security_id", "model_name", "raw_prediction").unionByName(panel.select("date", "security_id", F.lit("momentum_").alias("model_name"), F.col("mom_21_ex1").alias("raw_prediction")))))
    sides = long_short(joined, "raw_prediction", 0.1).where("side <> 0")
    # both sides of a date share the book evenly
    even = (F.col("side") * 0.5 / F.greatest(F.lit(1), F.count(F.lit(1)).over(_side()))).alias("weight")
    days = sides.select("date", "security_id", even, F.col("label_raw_1d_oo").alias("day_return"), F.col("adv20").alias("capacity"))
    put("holdings", days)
    days = get("holdings")
    scenarios = "scenario string, participation double, cost_rate double, aum_multiple double"
    costs = backtest(days.withColumn("capacity", F.lit(1e30)), spark.createDataFrame([(n, 1.0, r, 1.0) for n, r in COSTS.items()], scenarios))
    put("states", costs)
    put("costs", cost_table(get("states")))
    put("capacity", capacity_table(backtest(days, spark.createDataFrame([(f"aum{a}_p{p}", p, COSTS["base"], float(a)) for a, p in LADDER], scenarios))))
    state = get("states").where("scenario = 'base'").withColumn("r", F.try_divide("net_pnl", F.col("aum") - F.col("net_pnl")))
    put("equity", equity_curve(state.select("date", "r", "turnover"), "r"))
    put("summary", get("equity").agg(F.count("r").alias("days"), sharpe("r").alias("sharpe"), F.min("drawdown").alias("max_drawdown")))
    daily = get("ic").orderBy("date").select("rank_ic", "ic").collect()  # one row a session
    predictive = predictive_uncertainty([r[0] for r in daily], [r[1] for r in daily], seed=config.model.seed)
    book = portfolio_uncertainty([r[0] for r in get("equity").orderBy("date").select("r").collect()], max(1, len(REGISTRY[config.model.name].candidates(config)) if REGISTRY[config.model.name].candidates else 1), seed=config.model.seed)
    sharpes = {r["scenario"]: r["net_sharpe"] for r in get("costs").collect()}
    worst = lambda name, c, f: get(name).agg(f(c)).first()[0]
    observed = {
        "predictive_floor": predictive["rank_ic_ci_lower"], "deflated_sharpe": book.get("deflated_sharpe_ratio"), "regime_balance": worst("regimes", "ic", F.min),
        "position_concentration": get("holdings").agg(F.max(F.abs("weight"))).first()[0], "capacity_clip": worst("capacity", "mean_clipped", F.max),
    }
    gates = stability_gates(observed, sharpes.get("base"), sharpes.get("stress"))
    write_json(spark, f"{out}/evaluation/uncertainty.json", {"predictive": predictive, "portfolio": book, "gates": gates})


def _side():
    from pyspark.sql import Window

    return Window.partitionBy("date", "side")


def report(spark: SparkSession, out: str, config: Config) -> None:
    """The report as Markdown and HTML, with its figures as SVG; everything in it is an aggregate of sessions, buckets or scenarios."""
    read = lambda n: spark.read.parquet(f"{out}/evaluation/{n}")
    known = read_json(spark, f"{out}/evaluation/uncertainty.json")
    column = lambda df, c, by: [r[0] for r in df.orderBy(by).select(c).collect()]
    equity, ic, curve = read("equity"), read("ic"), read("decay")
    ends = decay_ends(curve).orderBy("horizon").collect()
    capacity, costs, coverage = read("capacity").orderBy("scenario").collect(), read("costs").orderBy("scenario").collect(), read("coverage")
    months = coverage.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(*(F.avg(f).alias(f) for f in config.model.features)).orderBy("month").collect()
    gates = known["gates"]
    figures = {
        "equity": lines({"equity": column(equity, "equity", "date")}, "Equity"), "drawdown": lines({"drawdown": column(equity, "drawdown", "date")}, "Drawdown"),
        "turnover": lines({"turnover": column(equity, "turnover", "date")}, "Turnover"), "rank_ic": lines({"rank IC": column(ic, "rank_ic", "date")}, "Daily rank IC"),
        "rolling_rank_ic": lines({"mean of 21": column(ic, "rolling_rank_ic", "date")}, "Rolling rank IC"), "pairs": lines({"rows": column(ic, "pairs", "date")}, "Scored rows"),
        "universe": lines({"rows": column(coverage, "rows", "date")}, "Panel rows"),
        "decay": lines({"top": [r["top"] for r in ends], "bottom": [r["bottom"] for r in ends]}, "Mean label of the end buckets by horizon"),
        "buckets": bars({f"{r['horizon']}d/{r['bucket']}": r["mean_label"] for r in curve.orderBy("horizon", "bucket").collect()}, "Mean label by bucket"),
        "capacity": bars({r["scenario"]: r["net_sharpe"] for r in capacity}, "Net Sharpe ratio by AUM and participation"),
        "costs": bars({r["scenario"]: r["net_sharpe"] for r in costs}, "Net Sharpe ratio by cost"),
        "coverage": heat_map([r["month"] for r in months], {f: [r[f] for r in months] for f in config.model.features}, "Feature coverage by month"),
    }
    pairs = lambda d: "\n".join(f"* {k}: {'-' if v is None else round(v, 6)}" for k, v in d.items())
    sections = {
        "Settings": "\n".join(f"* {k}: {v}" for k, v in snapshot(config)["values"].items()), "Model": f"{config.model.name}, tier {REGISTRY[config.model.name].tier}",
        "Features": ", ".join(config.model.features), "Folds": spark.read.parquet(f"{out}/folds").groupBy("role").agg(F.count_distinct("fold").alias("folds"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count("drop_reason").alias("dropped")),
        "Overlap": pairs({k: float(v) for k, v in read_json(spark, f"{out}/overlap.json").items()}), "Summary": read("summary"),
        "Mean information coefficients": ic.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic")), "Predictive uncertainty": pairs(known["predictive"]),
        "Hypotheses": read("hypotheses"), "Regimes": read("regimes"), "Decay": curve.orderBy("horizon", "bucket"), "Ends of the decay": decay_ends(curve).orderBy("horizon"),
        "Portfolio uncertainty": pairs(known["portfolio"]), "Costs": read("costs").orderBy("scenario"), "Capacity": read("capacity").orderBy("scenario"), "Correlations": read("correlations").orderBy("model_a", "model_b"),
        "Coverage": coverage.agg(*(F.avg(f).alias(f) for f in config.model.features)), "Gates": "\n".join(f"* {g['gate']}: {'passed' if g['passed'] else 'failed'} ({g['observed']} against {g['threshold']})" for g in gates),
        "Figures": ", ".join(figures), "Reproduction": f"config {config.hash}",
    }
    text = markdown(sections)
    write_json(spark, f"{out}/report.json", {"markdown": text, "html": html_report(sections, figures), "figures": figures, "config_hash": config.hash})

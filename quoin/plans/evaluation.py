"""Split, model, portfolio-selection and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.expr import by_date, grid, pct_rank_first, quantile_bucket
from quoin.operators.evaluate import aum_returns, correlation_matrix, daily_ic, decay, decay_ends, deltas, equity_curve, fdr, fold_stability, hypotheses, moments, regimes, rolling_ic, sensitivity, sharpe, unpivoted, wide_predictions
from quoin.operators.labels import forward_labels
from quoin.operators.models import BoostedStumps, blend_score, decile, elastic_net, gram, gram_of, momentum_score, random_score, rank_target, reversal_score, ridge, segment_products
from quoin.operators.splits import WalkForward, fold_roles, fold_summary, overlapping, protocol, segments
from quoin.plans.base import benchmark, calendar, grid_sql, normal_cdf_sql, sectors, universe
from quoin.plans.features import FUND_CTE
from quoin.plans.labels import LABEL_CTE, TRAIN_END, feature_base
from quoin.plans.features import pit_panel
from quoin.operators.features import with_fundamentals, with_price_features
from quoin.session import cut

#: Steps of the test's length, so that every month after the first training and validation is tested once; the embargo outlasts the purge.
SPEC = WalkForward(train=12, valid=2, test=1, step=1, embargo=8)
LINEAR = ["mom_21_ex1", "rev_1"]
WIDE = ["mom_21_ex1", "rev_1", "vol_21", "ret_5", "px_to_ma20", "hl_range_21"]
LABEL = "label_excess_5d_oo"
USED = {*LINEAR, *WIDE, "beta_estimate"}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every market row, with the features that scores and models here use."""
    return forward_labels(feature_base(spark, sf_dir, USED), benchmark(spark, sf_dir))


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price features, ratios of the facts known at the close, sectors and labels of every market row."""
    rows = with_price_features(with_fundamentals(pit_panel(spark, sf_dir)), benchmark(spark, sf_dir)).join(sectors(spark, sf_dir), "security_id", "left")
    return forward_labels(rows, benchmark(spark, sf_dir))


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns or ("date",)})


# splits
def fold_role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(fold_roles(calendar(spark, sf_dir), SPEC).select("fold", "date", "role", "drop_reason"))


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(fold_summary(fold_roles(calendar(spark, sf_dir), SPEC)), "first_date", "last_date")


def fold_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(fold_roles(calendar(spark, sf_dir), SPEC)).groupBy().agg(F.count(F.lit(1)).alias("overlaps"))


def validation_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each check, by fold: in the folds as they are, and in the same folds with nothing dropped, which break them."""
    roles = fold_roles(calendar(spark, sf_dir), SPEC)
    raw = roles.withColumn("drop_reason", F.lit(None).cast("string"))
    both = [protocol(r, SPEC, 310).withColumn("scope", F.lit(n)) for n, r in (("kept", roles), ("raw", raw))]
    return both[0].unionByName(both[1])


# models
def score_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = with_price_features(with_fundamentals(pit_panel(spark, sf_dir)), benchmark(spark, sf_dir))
    rows = base.select("security_id", "date", "mom_21_ex1", "rev_1", "book_to_price")
    scores = {"random": random_score(7), "reversal": reversal_score(), "momentum": momentum_score(), "blend": blend_score()}
    return _day(rows.select("security_id", "date", *(grid(c).alias(n) for n, c in scores.items())))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("date") < TRAIN_END)


def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge on two features, fitted on the training rows and applied to all."""
    model = ridge(gram(_train(spark, sf_dir), LINEAR, LABEL), 1.0)
    return _day(feature_base(spark, sf_dir, USED).select("security_id", "date", grid(model.predict()).alias("score")))


def linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of ridge, lasso, elastic net and rank ridge on six features: two passes over the training rows for all four."""
    train = _train(spark, sf_dir).select("security_id", "date", *WIDE, LABEL)
    g = gram(train, WIDE, LABEL)
    ranked = gram(train.withColumn("target", rank_target(LABEL)), WIDE, "target")
    fitted = {"ridge": ridge(g, 1.0), "lasso": elastic_net(g, 1e-5), "elastic_net": elastic_net(g, 1e-5, 0.5), "rank_ridge": ridge(ranked, 1.0)}
    rows = [(n, f, c) for n, m in fitted.items() for f, c in zip(["intercept", *m.features], [m.intercept, *m.coefficients])]
    return spark.createDataFrame(rows, "model_name string, feature string, coefficient double")


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted stumps of the operator's 50 rounds, fitted on the training rows and applied to all."""
    train = _train(spark, sf_dir).select(*WIDE, LABEL)
    model = BoostedStumps().fit(train, WIDE, LABEL)
    return _day(feature_base(spark, sf_dir, USED).select("security_id", "date", model.predict().alias("score")))


def oof_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores with rank and decile: a model per fold on its kept training dates, applied to its test dates. One pass sums what all folds
    need by segment of dates, another scores the rows with the coefficients of their date's fold."""
    panel = cut(scored(spark, sf_dir).select("security_id", "date", *LINEAR, LABEL))
    dates, kinds = segments(fold_roles(calendar(spark, sf_dir), SPEC))
    marked = panel.join(spark.createDataFrame(dates, "date date, segment int"), "date")  # one row a session
    parts = segment_products(marked, LINEAR, LABEL, "segment")
    models = {}
    for fold in sorted({f for k in kinds for f, _ in k}):
        own = [parts[i] for i, k in enumerate(kinds) if (fold, "train") in k and i in parts]
        if own:
            models[fold] = ridge(gram_of(own, LINEAR), 1.0)
    tests = [(d, f, [models[f].intercept, *models[f].coefficients]) for d, i in dates for f, role in kinds[i] if role == "test" and f in models]
    test = panel.join(spark.createDataFrame(tests, "date date, fold long, c array<double>"), "date")
    score = F.col("c")[0]
    for i, f in enumerate(LINEAR):
        score = score + F.col("c")[i + 1] * F.coalesce(F.col(f), F.lit(0.0))
    out = by_date(test.select("security_id", "date", "fold", score.alias("score")))
    ranked = out.withColumn("rank_prediction", pct_rank_first("score", "fold", "date"))
    return _day(ranked.withColumn("bucket", decile("rank_prediction")).select("security_id", "date", "fold", grid("score").alias("score"), grid("rank_prediction").alias("rank_prediction"), "bucket"))


# selection
def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longs and shorts of each date: the top and bottom tenth by momentum, ties by security; ranks and quintiles beside."""
    rows = feature_base(spark, sf_dir, USED).where("mom_21_ex1 IS NOT NULL").select("security_id", "date", "mom_21_ex1")
    day, k = Window.partitionBy("date"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("date")) * 0.1)
    up = F.row_number().over(day.orderBy(F.desc("mom_21_ex1"), "security_id"))
    down = F.row_number().over(day.orderBy("mom_21_ex1", "security_id"))
    ranked = rows.withColumns({"score_rank": pct_rank_first("mom_21_ex1", "date"), "quintile": quantile_bucket("mom_21_ex1", 5, "date"), "is_long": up <= k, "is_short": down <= k})
    return _day(ranked.select("security_id", "date", grid("score_rank").alias("score_rank"), "quintile", "is_long", "is_short"))


def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of one universe snapshot against those of the one before: full outer, missing weights zero."""
    days = universe(spark, sf_dir).where("in_universe")
    order = days.select("date").distinct().orderBy(F.desc("date")).limit(2).collect()  # the two last dates
    new, old = (order[0][0], order[-1][0]) if order else (None, None)
    weight = lambda d, n: days.where(F.col("date") == F.lit(d)).select("security_id", (F.lit(1.0) / F.count(F.lit(1)).over(_all())).alias(n))
    both = weight(new, "target").join(weight(old, "held"), "security_id", "full")
    both = both.select("security_id", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("held", F.lit(0.0)).alias("held"))
    return both.select("security_id", grid("target").alias("target"), grid("held").alias("held"), grid(F.col("target") - F.col("held")).alias("trade"))


def _all():
    return Window.partitionBy(F.lit(0))  # one date's securities


# evaluation
def ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = daily_ic(scored(spark, sf_dir), "mom_21_ex1", LABEL)
    return _day(out.select("date", grid("ic").alias("ic"), grid("rank_ic").alias("rank_ic"), "pairs"))


def ic_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = daily_ic(scored(spark, sf_dir), "mom_21_ex1", LABEL).join(regimes(benchmark(spark, sf_dir)), "date")
    return out.groupBy("regime").agg(grid(F.avg("ic")).alias("mean_ic"), grid(F.avg("rank_ic")).alias("mean_rank_ic"), F.count(F.lit(1)).alias("dates"))


def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decay(scored(spark, sf_dir), "mom_21_ex1", {h: f"label_excess_{h}d_oo" for h in (1, 5, 10, 20)})
    return out.select("horizon", "bucket", grid("mean_label").alias("mean_label"), "rows")


def decay_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest bucket of the decay curve per horizon."""
    out = decay_ends(decay(scored(spark, sf_dir), "mom_21_ex1", {h: f"label_excess_{h}d_oo" for h in (1, 5, 10, 20)}))
    return out.select("horizon", grid("bottom").alias("bottom"), grid("top").alias("top"))


def ic_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_ic(daily_ic(scored(spark, sf_dir), "mom_21_ex1", LABEL))
    return _day(out.select("date", grid("rolling_rank_ic").alias("rolling_rank_ic")))


def predictions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in long form, pivoted to one column a model."""
    long = unpivoted(feature_base(spark, sf_dir, USED), ("mom_21_ex1", "rev_1", "ret_5"), ["date", "security_id"], "model_name", "raw_prediction")
    out = wide_predictions(long, ("mom_21_ex1", "rev_1", "ret_5"))
    return _day(out.select("date", "security_id", *(grid(c).alias(c) for c in ("mom_21_ex1", "rev_1", "ret_5"))))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return of the top quintile less the bottom one."""
    rows = scored(spark, sf_dir).withColumn("b", quantile_bucket("mom_21_ex1", 5, "date")).where("b IN (0, 4) AND label_raw_1d_oo IS NOT NULL")
    return rows.groupBy("date").agg((F.avg(F.when(F.col("b") == 4, F.col("label_raw_1d_oo"))) - F.avg(F.when(F.col("b") == 0, F.col("label_raw_1d_oo")))).alias("r")).where("r IS NOT NULL")


def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = equity_curve(_returns(spark, sf_dir), "r")
    return curve.agg(F.count("r").alias("days"), grid(sharpe("r"), 4).alias("sharpe"), grid(F.min("drawdown")).alias("max_drawdown"), grid(F.max_by("equity", "date")).alias("final_equity"))


def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = moments(_returns(spark, sf_dir).withColumn("year", F.year("date")), "r", "year")
    return out.select("year", "n", *(grid(c, 5).alias(c) for c in ("mean", "std", "skew", "kurtosis")))


def aum_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on an AUM that gains or loses a fixed stake, one percent of its start, times each day's return."""
    rows = _returns(spark, sf_dir).withColumn("net_pnl", F.col("r") * 1e4)
    state = rows.withColumn("aum", 1e6 + F.sum("net_pnl").over(Window.partitionBy().orderBy("date")))  # one row a day
    return _day(aum_returns(state).select("date", grid("period_return").alias("period_return")))


def prediction_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_base(spark, sf_dir, USED)
    cells = F.array(*(F.struct(F.lit(m).alias("model_name"), F.col(m).alias("raw_prediction")) for m in ("mom_21_ex1", "rev_1", "ret_5")))
    long = rows.select("date", "security_id", F.explode(cells).alias("c")).select("date", "security_id", "c.*")
    out = correlation_matrix(long)
    return out.select("model_a", "model_b", grid("correlation").alias("correlation"), "rows")


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of test dates per fold, and its mean and spread over folds."""
    ic = daily_ic(scored(spark, sf_dir), "mom_21_ex1", LABEL)
    tests = fold_roles(calendar(spark, sf_dir), SPEC).where("role = 'test' AND drop_reason IS NULL").select("fold", "date")
    folds = ic.join(tests, "date").groupBy("fold").agg(F.avg("rank_ic").alias("rank_ic"), F.sum("pairs").alias("rows")).withColumn("model_name", F.lit("momentum"))
    out = fold_stability(folds)
    return out.select("model_name", "folds", *(grid(c).alias(c) for c in ("mean_rank_ic", "std_rank_ic", "mean_rows")))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank IC of each price feature as a score, by year: one pass over the panel for all."""
    long = unpivoted(scored(spark, sf_dir), ("mom_21_ex1", "rev_1", "ret_5", "vol_21"), ["date", LABEL])
    return daily_ic(long, "prediction", LABEL, "hypothesis").groupBy("hypothesis", F.year("date").alias("year")).agg(F.avg("rank_ic").alias("score"))


def hyper_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sensitivity(_trials(spark, sf_dir).withColumn("model_name", F.col("year").cast("string")))
    return out.select("model_name", "trials", *(grid(c).alias(c) for c in ("best", "median", "best_less_median", "top_two_gap")))


def model_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price feature as a hypothesis: mean rank IC, days and one-sided p of each year."""
    long = unpivoted(scored(spark, sf_dir), ("mom_21_ex1", "rev_1", "ret_5", "vol_21"), ["date", LABEL])
    out = hypotheses(daily_ic(long, "prediction", LABEL, "hypothesis").withColumn("year", F.year("date")), "year", "hypothesis")
    return out.select("year", "hypothesis", grid("rank_ic_mean").alias("rank_ic_mean"), "days", grid("p").alias("p"))


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-discovery control over the hypotheses' p-values, by year."""
    out = fdr(model_hypotheses(spark, sf_dir).select("hypothesis", "year", "p"), "year", "p", 0.2)
    return out.select("year", "hypothesis", "p", "rank", grid("threshold").alias("threshold"), "rejected")


def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deltas(_trials(spark, sf_dir), "year", "hypothesis", "score")
    return out.select("year", "hypothesis", grid("score_delta").alias("score_delta"))


def universe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(universe(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count_if("in_universe").alias("inside")))


def coverage_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with a momentum score by sector and month."""
    rows = feature_base(spark, sf_dir, USED)
    out = rows.groupBy("sector", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("mom_21_ex1").alias("present"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("coverage", grid(F.col("present") / F.col("rows")))


QUERIES = {f.__name__: f for f in (
    fold_role_matrix, fold_sizes, fold_overlaps, score_heuristics, ridge_scores, linear_models, boosted_scores, oof_ridge, score_ranks, trade_list, ic_daily, ic_by_regime, decay_curve,
    validation_protocol, ic_rolling, decay_top_bottom, predictions_wide, model_hypotheses,
    portfolio_metrics, return_moments, aum_path, prediction_correlations, stability, hyper_sensitivity, bh_fdr, ablation_deltas, universe_size, coverage_heatmap,
)}

# --- DuckDB ---------------------------------------------------------------------------------------------------------
_S = SPEC
_ROLES = f"""fm AS (SELECT session_date, session_no, dense_rank() OVER (ORDER BY strftime(session_date, '%Y-%m')) - 1 AS m FROM trading_calendar),
fk AS (SELECT unnest(range(0, ((max(m) + 1 - {_S.train + _S.valid + _S.test}) // {_S.step}) + 1)) AS fold FROM fm),
fr0 AS (SELECT fold, session_date, session_no, CASE WHEN m - fold * {_S.step} < {_S.train} THEN 'train' WHEN m - fold * {_S.step} < {_S.train + _S.valid} THEN 'valid' ELSE 'test' END AS role
  FROM fk JOIN fm ON m >= fold * {_S.step} AND m < fold * {_S.step} + {_S.train + _S.valid + _S.test}),
fb0 AS (SELECT fold, min(session_no) FILTER (WHERE role = 'valid') AS v, min(session_no) FILTER (WHERE role = 'test') AS t FROM fr0 GROUP BY 1),
fr AS (SELECT fr0.*, CASE role WHEN 'train' THEN CASE WHEN session_no + 1 + {_S.horizon} >= v THEN 'purged' WHEN v - session_no <= {_S.embargo} THEN 'embargoed' END
  WHEN 'valid' THEN CASE WHEN session_no + 1 + {_S.horizon} >= t THEN 'purged' WHEN t - session_no <= {_S.embargo} THEN 'embargoed' END END AS drop_reason FROM fr0 JOIN fb0 USING (fold))"""


def _corr(a: str, b: str) -> str:
    ok = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    x, y = f"CASE WHEN {ok} THEN {a} END", f"CASE WHEN {ok} THEN {b} END"
    return f"CASE WHEN count({x}) >= 2 AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _avg_rank(c: str, ok: str) -> str:
    return f"CASE WHEN {ok} THEN (rank() OVER (PARTITION BY date, {ok} ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {ok}, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date, {ok}) END"


# labels with the price features of their rows
SCORED = LABEL_CTE + ", sc AS (SELECT ll.*, px.mom_21_ex1, px.rev_1, px.ret_5, px.vol_21 FROM ll JOIN px USING (security_id, date))"


def _ic(c: str, name: str) -> str:
    ok = f"({c} IS NOT NULL AND {LABEL} IS NOT NULL)"
    return f"""{name}0 AS (SELECT date, {c} AS p, {LABEL} AS y, {_avg_rank(c, ok)} AS rp, {_avg_rank(LABEL, ok)} AS rl FROM sc),
{name} AS (SELECT date, {_corr('p', 'y')} AS ic, {_corr('rp', 'rl')} AS rank_ic, count(*) FILTER (WHERE p IS NOT NULL AND y IS NOT NULL) AS pairs FROM {name}0 GROUP BY date)"""


def _bucket(c: str) -> str:
    n = f"count({c}) OVER (PARTITION BY date)"
    return f"CASE WHEN {c} IS NOT NULL AND {n} >= 5 THEN greatest(ceil(5.0::DOUBLE * (row_number() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}, security_id) - 1) / ({n} - 1)) - 1, 0)::INT END"


_IC = f"WITH {SCORED}, {_ic('mom_21_ex1', 'ic')}"
_RETURNS = f"""WITH {SCORED}, bk AS (SELECT *, {_bucket('mom_21_ex1')} AS b FROM sc),
rt AS (SELECT date, avg(label_raw_1d_oo) FILTER (WHERE b = 4) - avg(label_raw_1d_oo) FILTER (WHERE b = 0) AS r FROM bk WHERE b IN (0, 4) AND label_raw_1d_oo IS NOT NULL GROUP BY 1),
rr AS (SELECT * FROM rt WHERE r IS NOT NULL), eq AS (SELECT date, r, CASE WHEN bool_or(r <= -1) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER w) END AS equity FROM rr WINDOW w AS (ORDER BY date)),
dd AS (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY date)) - 1 AS drawdown FROM eq)"""
_NAMES = ("mom_21_ex1", "rev_1", "ret_5", "vol_21")
_TRIALS = f"WITH {SCORED}, " + ", ".join(_ic(c, f"t{i}") for i, c in enumerate(_NAMES)) + ", tr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS hypothesis, year(date) AS year, avg(rank_ic) AS score FROM t{i} GROUP BY 2" for i, c in enumerate(_NAMES)) + ")"
_HYPOTHESES = f"WITH {SCORED}, " + ", ".join(_ic(c, f"t{i}") for i, c in enumerate(_NAMES)) + ", hd AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS hypothesis, year(date) AS year, rank_ic AS r FROM t{i}" for i, c in enumerate(_NAMES)
) + f"""), ht AS (SELECT year, hypothesis, avg(r) AS m, count(r) AS days, CASE WHEN count(r) >= 2 AND stddev_samp(r) > 1e-12 THEN avg(r) / (stddev_samp(r) / sqrt(count(r))) END AS t FROM hd GROUP BY 1, 2),
hy AS (SELECT *, 1 - ({normal_cdf_sql('t')}) AS p FROM ht)"""  # fmt: skip


def _protocol(name: str, where: str) -> str:
    end = f"session_no + 1 + {_S.horizon}"
    cells = {
        "no_overlap": "count(*) FILTER (WHERE times > 1)", "min_sample_sizes": "(count(*) < 310)::BIGINT",
        "purge_validity": f"count(*) FILTER (WHERE (role = 'train' AND {end} >= v) OR (role = 'valid' AND {end} >= t))",
        "embargo_validity": f"coalesce((v - max(session_no) FILTER (WHERE role = 'train') <= {_S.embargo})::BIGINT, 0) + coalesce((t - max(session_no) FILTER (WHERE role = 'valid') <= {_S.embargo})::BIGINT, 0)",
        "calendar_contiguity": "count(*) FILTER (WHERE (role = 'train' AND session_no >= v) OR (role = 'valid' AND session_no >= t))",
        "label_window_separation": f"count(*) FILTER (WHERE role = 'train' AND ({end} >= v OR {end} >= t))",
    }
    rows = " UNION ALL ".join(f"SELECT fold, '{c}' AS check, {x}::BIGINT AS violations, '{name}' AS scope FROM pd_{name} GROUP BY fold, v, t" for c, x in cells.items())
    return f"pd_{name} AS (SELECT fr.*, v, t, count(*) OVER (PARTITION BY fold, fr.session_date) AS times FROM fr JOIN fb0 USING (fold) WHERE {where}), pr_{name} AS ({rows})"


_PAIRS = [(a, b) for a in _NAMES[:3] for b in _NAMES[:3]]
SQL = {
    "fold_role_matrix": f"WITH {_ROLES} SELECT fold, strftime(session_date, '%Y-%m-%d') AS date, role, drop_reason FROM fr",
    "fold_sizes": f"""WITH {_ROLES} SELECT fold, role, count(*) AS dates, count(*) FILTER (WHERE drop_reason IS NULL) AS kept, count(*) FILTER (WHERE drop_reason = 'purged') AS purged,
  strftime(min(session_date), '%Y-%m-%d') AS first_date, strftime(max(session_date), '%Y-%m-%d') AS last_date FROM fr GROUP BY 1, 2""",
    "fold_overlaps": f"WITH {_ROLES}, o AS (SELECT fold, session_date FROM fr WHERE drop_reason IS NULL GROUP BY 1, 2 HAVING count(DISTINCT role) > 1) SELECT count(*) AS overlaps FROM o",
    "score_heuristics": f"""WITH {LABEL_CTE}, {FUND_CTE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date,
  {grid_sql("('0x' || substr(sha256('7|' || strftime(date, '%Y-%m-%d') || '|' || security_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE")} AS random,
  {grid_sql('rev_1')} AS reversal, {grid_sql('mom_21_ex1')} AS momentum,
  {grid_sql('0.5 * coalesce(mom_21_ex1, 0) + 0.3 * coalesce(book_to_price, 0) + 0.2 * coalesce(rev_1, 0)')} AS blend FROM px JOIN (SELECT security_id, date, book_to_price FROM fu) USING (security_id, date)""",
    "ridge_scores": f"""WITH {SCORED}, tn AS (SELECT mom_21_ex1 a, rev_1 b, {LABEL} y FROM sc WHERE date < DATE '{TRAIN_END}' AND mom_21_ex1 IS NOT NULL AND rev_1 IS NOT NULL AND {LABEL} IS NOT NULL),
g AS (SELECT avg(a) ma, avg(b) mb, avg(y) my, var_pop(a) * count(*) + 1 aa, var_pop(b) * count(*) + 1 bb, covar_pop(a, b) * count(*) ab, covar_pop(a, y) * count(*) ay, covar_pop(b, y) * count(*) yb FROM tn),
m AS (SELECT ma, mb, my, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS c1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM g)
SELECT security_id, strftime(date, '%Y-%m-%d') AS date, {grid_sql('my - ma * c1 - mb * c2 + c1 * coalesce(mom_21_ex1, 0) + c2 * coalesce(rev_1, 0)')} AS score FROM px, m""",
    "score_ranks": f"""WITH {LABEL_CTE}, s AS (SELECT security_id, date, mom_21_ex1 AS x, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY mom_21_ex1, security_id) AS r,
  row_number() OVER (PARTITION BY date ORDER BY mom_21_ex1 DESC, security_id) AS d FROM px WHERE mom_21_ex1 IS NOT NULL)
SELECT security_id, strftime(date, '%Y-%m-%d') AS date, {grid_sql('r / n')} AS score_rank, CASE WHEN n >= 5 THEN greatest(ceil(5.0::DOUBLE * (r - 1) / (n - 1)) - 1, 0)::INT END AS quintile,
  d <= ceil(n * 0.1::DOUBLE) AS is_long, r <= ceil(n * 0.1::DOUBLE) AS is_short FROM s""",
    "trade_list": f"""WITH u AS (SELECT date, security_id, bool_or(is_in_universe) AS i FROM universe_snapshot GROUP BY 1, 2), v AS (SELECT * FROM u WHERE i),
d AS (SELECT DISTINCT date FROM v ORDER BY 1 DESC LIMIT 2), n AS (SELECT security_id, 1.0::DOUBLE / count(*) OVER () AS w FROM v WHERE date = (SELECT max(date) FROM d)),
o AS (SELECT security_id, 1.0::DOUBLE / count(*) OVER () AS w FROM v WHERE date = (SELECT min(date) FROM d))
SELECT security_id, {grid_sql('coalesce(n.w, 0)')} AS target, {grid_sql('coalesce(o.w, 0)')} AS held, {grid_sql('coalesce(n.w, 0) - coalesce(o.w, 0)')} AS trade FROM n FULL JOIN o USING (security_id)""",
    "ic_daily": f"{_IC} SELECT strftime(date, '%Y-%m-%d') AS date, {grid_sql('ic')} AS ic, {grid_sql('rank_ic')} AS rank_ic, pairs FROM ic",
    "ic_by_regime": f"""{_IC}, rg AS (SELECT date, CASE WHEN coalesce(close / lag(close, 63) OVER (ORDER BY date) - 1, 0) >= 0 THEN 'risk_on' ELSE 'risk_off' END AS regime FROM bm)
SELECT regime, {grid_sql('avg(ic)')} AS mean_ic, {grid_sql('avg(rank_ic)')} AS mean_rank_ic, count(*) AS dates FROM ic JOIN rg USING (date) GROUP BY 1""",
    "decay_curve": f"WITH {SCORED}, bk AS (SELECT *, {_bucket('mom_21_ex1')} AS bucket FROM sc) "
    + " UNION ALL ".join(f"SELECT {h} AS horizon, bucket, {grid_sql(f'avg(label_excess_{h}d_oo)')} AS mean_label, count(label_excess_{h}d_oo) AS rows FROM bk WHERE bucket IS NOT NULL GROUP BY 2" for h in (1, 5, 10, 20)),
    "portfolio_metrics": f"{_RETURNS} SELECT count(*) AS days, {grid_sql('avg(r) / stddev_pop(r) * sqrt(252)', 4)} AS sharpe, {grid_sql('min(drawdown)')} AS max_drawdown, {grid_sql('arg_max(equity, date)')} AS final_equity FROM dd",
    "return_moments": f"""{_RETURNS}, z AS (SELECT year(date) AS year, r, avg(r) OVER (PARTITION BY year(date)) m, stddev_pop(r) OVER (PARTITION BY year(date)) s FROM rr)
SELECT year, count(*) AS n, {grid_sql('avg(r)', 5)} AS mean, {grid_sql('stddev_pop(r)', 5)} AS std, {grid_sql('avg(((r - m) / s) ** 3)', 5)} AS skew, {grid_sql('avg(((r - m) / s) ** 4)', 5)} AS kurtosis FROM z GROUP BY 1""",
    "aum_path": f"""{_RETURNS}, ap AS (SELECT date, r * 10000 AS pnl, 1000000 + sum(r * 10000) OVER (ORDER BY date) AS aum FROM rr)
SELECT strftime(date, '%Y-%m-%d') AS date, {grid_sql('pnl / coalesce(lag(aum) OVER (ORDER BY date), aum - pnl)')} AS period_return FROM ap""",
    "prediction_correlations": f"WITH {SCORED} " + " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, {grid_sql(_corr(a, b))} AS correlation, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS rows FROM px" for a, b in _PAIRS),
    "stability": f"""{_IC}, {_ROLES}, f AS (SELECT fold, avg(rank_ic) AS v, sum(pairs) AS n FROM ic JOIN fr ON fr.session_date = ic.date WHERE role = 'test' AND drop_reason IS NULL GROUP BY 1)
SELECT 'momentum' AS model_name, count(*) AS folds, {grid_sql('avg(v)')} AS mean_rank_ic, {grid_sql('stddev_pop(v)')} AS std_rank_ic, {grid_sql('avg(n)')} AS mean_rows FROM f""",
    "hyper_sensitivity": f"""{_TRIALS}, s AS (SELECT year, score, row_number() OVER (PARTITION BY year ORDER BY score DESC) AS k FROM tr)
SELECT year::VARCHAR AS model_name, count(score) AS trials, {grid_sql('max(score)')} AS best, {grid_sql('median(score)')} AS median, {grid_sql('max(score) - median(score)')} AS best_less_median,
  {grid_sql('max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2)')} AS top_two_gap FROM s GROUP BY 1""",
    "model_hypotheses": f"{_HYPOTHESES} SELECT year, hypothesis, {grid_sql('m')} AS rank_ic_mean, days, {grid_sql('p')} AS p FROM hy",
    "bh_fdr": f"""{_HYPOTHESES}, p AS (SELECT hypothesis, year, {grid_sql('p')} AS p FROM hy), k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY p NULLS LAST, hypothesis) AS rank, count(*) OVER (PARTITION BY year) AS m FROM p)
SELECT year, hypothesis, p, rank, {grid_sql('rank / m * 0.2::DOUBLE')} AS threshold, coalesce(p <= rank / m * 0.2::DOUBLE, false) AS rejected FROM k""",
    "ic_rolling": f"""{_IC} SELECT strftime(date, '%Y-%m-%d') AS date, {grid_sql('CASE WHEN count(rank_ic) OVER w >= 3 THEN avg(rank_ic) OVER w END')} AS rolling_rank_ic FROM ic
  WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "decay_top_bottom": f"WITH {SCORED}, bk AS (SELECT *, {_bucket('mom_21_ex1')} AS bucket FROM sc), dc AS ("
    + " UNION ALL ".join(f"SELECT {h} AS horizon, bucket, avg(label_excess_{h}d_oo) AS y FROM bk WHERE bucket IS NOT NULL GROUP BY 2" for h in (1, 5, 10, 20))
    + f") SELECT horizon, {grid_sql('arg_min(y, bucket)')} AS bottom, {grid_sql('arg_max(y, bucket)')} AS top FROM dc GROUP BY 1",
    "predictions_wide": f"WITH {LABEL_CTE} SELECT strftime(date, '%Y-%m-%d') AS date, security_id, {', '.join(f'{grid_sql(c)} AS {c}' for c in _NAMES[:3])} FROM px",
    "validation_protocol": f"WITH {_ROLES}, " + ", ".join(_protocol(n, w) for n, w in (("kept", "drop_reason IS NULL"), ("raw", "true"))) + " SELECT * FROM pr_kept UNION ALL SELECT * FROM pr_raw",
    "oof_ridge": f"""WITH {SCORED}, {_ROLES}, tn AS (SELECT fold, mom_21_ex1 a, rev_1 b, {LABEL} y FROM sc JOIN fr ON fr.session_date = sc.date WHERE role = 'train' AND drop_reason IS NULL
  AND mom_21_ex1 IS NOT NULL AND rev_1 IS NOT NULL AND {LABEL} IS NOT NULL),
g AS (SELECT fold, avg(a) ma, avg(b) mb, avg(y) my, var_pop(a) * count(*) + 1 aa, var_pop(b) * count(*) + 1 bb, covar_pop(a, b) * count(*) ab, covar_pop(a, y) * count(*) ay, covar_pop(b, y) * count(*) yb FROM tn GROUP BY 1),
m AS (SELECT fold, ma, mb, my, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS c1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM g),
s AS (SELECT security_id, date, fold, my - ma * c1 - mb * c2 + c1 * coalesce(mom_21_ex1, 0) + c2 * coalesce(rev_1, 0) AS score FROM sc JOIN fr ON fr.session_date = sc.date JOIN m USING (fold) WHERE role = 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY fold, date ORDER BY score, security_id) / count(*) OVER (PARTITION BY fold, date) AS k FROM s)
SELECT security_id, strftime(date, '%Y-%m-%d') AS date, fold, {grid_sql('score')} AS score, {grid_sql('k')} AS rank_prediction, least(floor(k * 10), 9)::INT AS bucket FROM r""",
    "ablation_deltas": f"{_TRIALS} SELECT year, hypothesis, {grid_sql('score - first_value(score) OVER (PARTITION BY year ORDER BY hypothesis)')} AS score_delta FROM tr",
    "universe_size": "WITH u AS (SELECT date, security_id, bool_or(is_in_universe) AS i FROM universe_snapshot GROUP BY 1, 2) SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS rows, count(*) FILTER (WHERE i) AS inside FROM u GROUP BY 1",
    "coverage_heatmap": f"WITH {LABEL_CTE} SELECT sector, strftime(date, '%Y-%m') AS month, count(mom_21_ex1) AS present, count(*) AS rows, {grid_sql('count(mom_21_ex1) / count(*)')} AS coverage FROM px LEFT JOIN sx USING (security_id) GROUP BY 1, 2",
}

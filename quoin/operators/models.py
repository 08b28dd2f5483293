"""Scores and models. Linear models need one pass: centred cross products, summed in Arrow batches and merged pairwise, so nothing cancels; what the
driver solves has the size of the features, not of the rows. Boosted stumps need one pass per round, over histograms."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.expr import pct_rank
from quoin.operators.quantiles import exact_quantiles
from quoin.operators.runs import floats
from quoin.session import cut


def random_score(seed: int, date: str = "date", key: str = "security_id") -> Column:
    """Uniform in [0, 1]: the first 64 bits of a SHA-256 of seed, date and security."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.date_format(date, "yyyy-MM-dd"), F.col(key)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64 - 1)


def reversal_score() -> Column:
    return F.col("rev_1")


def momentum_score() -> Column:
    return F.col("mom_21_ex1")


def blend_score() -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.5 * zero("mom_21_ex1") + 0.3 * zero("book_to_price") + 0.2 * zero("rev_1")


@dataclass
class Gram:
    """Means and centred cross products of features and label over complete rows."""

    features: list[str]
    n: int
    mean: np.ndarray
    label_mean: float
    xx: np.ndarray
    xy: np.ndarray


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two parts together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


_PARTS = "segment int, n long, mean array<double>, products array<double>"


def _emit(parts: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    keys = sorted(parts)
    columns = [pa.array(keys, pa.int32()), pa.array([parts[k][0] for k in keys], pa.int64()), pa.array([parts[k][1].tolist() for k in keys], pa.list_(pa.float64())), pa.array([parts[k][2].ravel().tolist() for k in keys], pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["segment", "n", "mean", "products"])


def _products(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple] = {}
        for batch in batches:
            x = np.column_stack([floats(batch.column(i)) for i in range(width)])
            whole = np.isfinite(x).all(axis=1)
            segment = batch.column("segment").to_numpy(zero_copy_only=False)
            for s in np.unique(segment[whole]).tolist():
                own = x[whole & (segment == s)]
                mean = own.mean(axis=0)
                part = (len(own), mean, (own - mean).T @ (own - mean))
                parts[s] = _joined(parts[s], part) if s in parts else part
        yield from _emit(parts)

    return task


def _merged(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple] = {}
        for batch in batches:
            for s, n, mean, products in zip(*(c.to_pylist() for c in batch.columns)):
                part = (n, np.array(mean), np.array(products).reshape(width, width))
                parts[s] = _joined(parts[s], part) if s in parts else part
        yield from _emit(parts)

    return task


def segment_products(rows: DataFrame, features: Sequence[str], label: str, segment: str) -> dict[int, tuple]:
    """(count, mean, centred products) of features and label over the complete rows of each value of the int column ``segment``: one pass for all. The
    driver gets the square of the features per segment, so segments must be few; rows without one are left out."""
    width = len(features) + 1
    own = rows.where(F.col(segment).isNotNull()).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate((*features, label))), F.col(segment).cast("int").alias("segment"))
    parts = own.mapInArrow(_products(width), _PARTS).repartition("segment").mapInArrow(_merged(width), _PARTS)
    return {r["segment"]: (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(width, width)) for r in parts.toLocalIterator()}


def gram_of(parts: Sequence[tuple], features: Sequence[str]) -> Gram:
    """The Gram matrix of segments together."""
    whole = (0, None, None)
    for part in parts:
        whole = _joined(whole, part)
    n, mean, products = whole
    if not n:
        raise ValueError("no complete rows")
    return Gram(list(features), n, mean[:-1], float(mean[-1]), products[:-1, :-1], products[:-1, -1])


def gram(rows: DataFrame, features: Sequence[str], label: str) -> Gram:
    """One pass over the rows that have every feature and the label; infinite values count as missing."""
    return gram_of(list(segment_products(rows.withColumn("segment_", F.lit(0)), features, label, "segment_").values()), features)


@dataclass
class LinearModel:
    """intercept + sum of coefficient x feature, nulls as zero."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    params: dict = field(default_factory=dict)

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients):
            out = out + F.lit(c) * F.coalesce(F.col(f), F.lit(0.0))
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> LinearModel:
        return LinearModel(**json.loads(text))


def _model(g: Gram, beta: np.ndarray, **params) -> LinearModel:
    return LinearModel(g.features, [float(b) for b in beta], float(g.label_mean - g.mean @ beta), params)


def ridge(g: Gram, alpha: float) -> LinearModel:
    return _model(g, np.linalg.solve(g.xx + alpha * np.eye(len(g.mean)), g.xy), alpha=alpha)


def elastic_net(g: Gram, alpha: float, l1_ratio: float = 1.0, rounds: int = 800, tolerance: float = 1e-6) -> LinearModel:
    """Cyclic coordinate descent on the Gram matrix, for loss / (2n) + alpha (l1 |b| + (1 - l1) b^2 / 2); the lasso at ratio one."""
    a, c = g.xx / g.n, g.xy / g.n
    beta = np.zeros(len(c))
    for _ in range(rounds):
        before = beta.copy()
        for i in range(len(c)):
            if a[i, i] <= 1e-15:
                continue
            rest = c[i] - a[i] @ beta + a[i, i] * beta[i]
            beta[i] = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / (a[i, i] + alpha * (1 - l1_ratio))
        if np.abs(beta - before).max() < tolerance:
            break
    return _model(g, beta, alpha=alpha, l1_ratio=l1_ratio)


def rank_target(label: str) -> Column:
    """Percentile rank by date, centred: the target of rank models."""
    return pct_rank(label, "date") - 0.5


@dataclass
class BoostedStumps:
    """Least-squares boosting of one-split trees over quantile thresholds, on the ``keep`` features most correlated with the label.

    Rows are binned once. A round adds one split: every task sums residuals per feature and bin, the sums are added up by Spark, and the
    driver picks the best split of a table of features x bins. Tasks replay the splits so far, so no residuals are stored.
    """

    rounds: int = 50
    rate: float = 0.1
    bins: int = 16
    least_leaf: int = 20
    keep: int = 16
    features: list[str] = field(default_factory=list)
    thresholds: list[list[float]] = field(default_factory=list)
    medians: list[float] = field(default_factory=list)
    base: float = 0.0
    splits: list[tuple[int, int, float, float]] = field(default_factory=list)  # feature, bin, value up to it, value above

    def fit(self, rows: DataFrame, features: Sequence[str], label: str) -> BoostedStumps:
        rows = cut(rows.where(F.col(label).isNotNull()).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias(label)))  # read several times
        mean = rows.agg(F.avg(label)).first()[0]
        if mean is None:
            raise ValueError("no labelled rows")
        medians = {f: (m[0] if m else 0.0) for f, m in exact_quantiles(rows, features, [0.5]).items()}
        filled = rows.withColumns({f: F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.lit(medians[f])) for f in features})
        moments = filled.agg(*(F.try_divide(F.covar_pop(f, label), F.stddev_pop(f) * F.stddev_pop(label)).alias(f) for f in features)).first()
        order = sorted(range(len(features)), key=lambda i: -abs(moments[features[i]] or 0.0))[: self.keep]
        self.features, self.base = [features[i] for i in order], mean
        self.medians = [medians[f] for f in self.features]
        cuts = exact_quantiles(filled, self.features, [float(q) for q in np.linspace(0.1, 0.9, self.bins)])
        self.thresholds = [sorted(set(cuts[f])) for f in self.features]
        binned = cut(filled.select(*(self._bin(i).alias(f"b{i}") for i in range(len(self.features))), F.col(label).cast("double").alias("y")))
        self.splits = []
        for _ in range(self.rounds):
            parts = binned.mapInArrow(self._histogram(), "feature int, bin int, n long, total double")
            table = parts.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
            if (best := self._best(table)) is None:
                break
            self.splits.append(best)
        return self

    def _bin(self, i: int) -> Column:
        out = F.lit(0)
        for t in self.thresholds[i]:
            out = out + (F.coalesce(F.col(self.features[i]).cast("double"), F.lit(self.medians[i])) > F.lit(t)).cast("int")
        return out

    def _histogram(self):
        splits, base, width, bins = list(self.splits), self.base, len(self.features), self.bins + 1

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros((width, bins), dtype=np.int64), np.zeros((width, bins))
            for batch in batches:
                x = np.column_stack([batch.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(width)]) if batch.num_rows else np.zeros((0, width), dtype=int)
                left = floats(batch.column("y")) - base
                for f, b, low, high in splits:
                    left = left - np.where(x[:, f] <= b, low, high)
                for i in range(width):
                    n[i] += np.bincount(x[:, i], minlength=bins)
                    total[i] += np.bincount(x[:, i], weights=left, minlength=bins)
            f, b = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[f, b]), pa.array(total[f, b])], names=["feature", "bin", "n", "total"])

        return task

    def _best(self, table) -> tuple[int, int, float, float] | None:
        best, most = None, 1e-12
        n, total = np.zeros((len(self.features), self.bins + 1)), np.zeros((len(self.features), self.bins + 1))
        n[table["feature"], table["bin"]], total[table["feature"], table["bin"]] = table["n"], table["total"]
        for f in range(len(self.features)):
            low_n, low_t = np.cumsum(n[f])[:-1], np.cumsum(total[f])[:-1]
            high_n, high_t = n[f].sum() - low_n, total[f].sum() - low_t
            for b in np.flatnonzero((low_n >= self.least_leaf) & (high_n >= self.least_leaf)):
                whole = n[f].sum()
                gain = (low_t[b] ** 2 / low_n[b] + high_t[b] ** 2 / high_n[b] - total[f].sum() ** 2 / whole) / whole
                if gain > most + 1e-12:
                    most, best = gain, (f, int(b), float(self.rate * low_t[b] / low_n[b]), float(self.rate * high_t[b] / high_n[b]))
        return best

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=int)

    @staticmethod
    def from_json(text: str) -> BoostedStumps:
        values = json.loads(text)
        return BoostedStumps(**values | {"splits": [tuple(s) for s in values["splits"]]})

    def predict(self) -> Column:
        out = F.lit(self.base)
        bins = [self._bin(i) for i in range(len(self.features))]
        for f, b, low, high in self.splits:
            out = out + F.when(bins[f] <= b, low).otherwise(high)
        return out


#: Search space of boosted models.
BOOSTING = {"rounds": (12, 24), "rate": (0.05, 0.1), "bins": (8, 12, 16), "least_leaf": (12, 24)}


def boosting_candidates(trials: int | None = None, seed: int = 42) -> list[dict]:
    """Combinations of BOOSTING in a seeded order: ``trials`` of them, or 16, and at least one."""
    space = grid_of(**BOOSTING)
    return some_of(space, max(1, min(16 if trials is None else trials, len(space))), seed)


def grid_of(**options: Sequence) -> list[dict]:
    """All combinations of the options."""
    out: list[dict] = [{}]
    for name, values in options.items():
        out = [o | {name: v} for o in out for v in values]
    return out


def some_of(combinations: Sequence[dict], trials: int, seed: int) -> list[dict]:
    """The first ``trials`` of a seeded permutation."""
    return [combinations[i] for i in np.random.default_rng(seed).permutation(len(combinations))[:trials]]


def tune(candidates: Sequence[dict], fit, score) -> tuple[dict, float]:
    """The first candidate of the best score; ``fit(params)`` gives a model, ``score(model)`` a number or None."""
    best: tuple[dict, float] | None = None
    for params in candidates:
        value = score(fit(params))
        if value is not None and (best is None or value > best[1]):
            best = (params, value)
    if best is None:
        raise ValueError("no candidate has a score")
    return best


def decile(rank: str | Column) -> Column:
    return F.least(F.floor((F.col(rank) if isinstance(rank, str) else rank) * 10), F.lit(9)).cast("int")

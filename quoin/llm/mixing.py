"""Mixing sources to target weights.

Method: soft-membership mixing. A document's membership in the sources is their posterior given all that is known of it: the label where it has
one, else what a classifier says of its text. The classifier is naive Bayes over the tokens and token pairs that a text has, fitted on
labelled documents, at most about ``FIT`` of each source. Nonnegative document rates, at most max_repeats, are fitted by projected-gradient
least squares so that the expected tokens of each source, by membership, match the targets. A pass over the documents yields the
totals; only those, one number per mix and source, reach the driver, and a document's rate is replayed from the moves of the passes
before, so no state is kept between passes. Passes end when totals settle; shares say whether they did.

Gradients are scaled by the tokens a source has, so a pass moves all documents of a source alike, whatever their lengths. Rates become
whole copies in shards, longest documents first, each source carrying its rounding error on to its next document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quoin.llm.tokens import default_vocabulary, encoding
from quoin.operators.runs import co_sorted, ints, key_runs
from quoin.session import cut, spread

#: Buckets of tokens and token pairs at most; bytes of the model at most, which make them fewer where sources are many, and buckets at least.
BUCKETS, MODEL_BYTES, LEAST_BUCKETS = 1 << 15, 64 << 20, 1 << 8
#: Labelled documents of a source that the classifier is fitted on, roughly, chosen by hash.
FIT = 2_000
#: Passes at most; relative change of totals that ends them.
PASSES, SETTLED = 100, 1e-6
#: Features whose evidence a posterior counts at most: parts of one text are not independent.
EVIDENCE = 60.0
#: Documents of a rounding shard, roughly.
SHARD = 20_000


@dataclass(frozen=True)
class Mix:
    name: str
    shares: dict[str, float]
    max_repeats: int
    size_ratio: float


def buckets_for(sources: int) -> int:
    """Buckets of a model of so many sources; a power of two, and so few that the model keeps its size."""
    out = BUCKETS
    while out * sources * 4 > MODEL_BYTES and out > LEAST_BUCKETS:
        out //= 2
    if out * sources * 4 > MODEL_BYTES:
        raise ValueError(f"{sources} sources are more than a model of {MODEL_BYTES} bytes tells apart")
    return out


def features(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of the tokens and neighbouring pairs of a text, each once."""
    return np.unique(np.concatenate([ids % buckets, (ids[:-1] * 31 + ids[1:] * 1_000_003) % buckets]))


def _bucket_counts(path: str, sources: Sequence[str], buckets: int):
    index = {s: i for i, s in enumerate(sources)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        table = np.zeros((len(sources), buckets), dtype=np.int32)
        for batch in batches:
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist()):
                table[index[source], features(np.array(encode(text), dtype=np.int64), buckets)] += 1
        row, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[row, bucket].astype(np.int64))], names=["row", "bucket", "n"])

    return task


def fit_classifier(documents: DataFrame, counts: dict[str, int], vocabulary: str) -> np.ndarray:
    """Log-probabilities, sources x buckets, with the log prior of each source in a last column. ``counts``: documents of each source, in the order of
    rows; of a source with more than ``FIT`` those whose hash is small enough are read."""
    sources = list(counts)
    buckets = buckets_for(len(sources))
    parts = 1 << 30
    kept = documents.sparkSession.createDataFrame([(s, max(1, int(parts * min(1.0, FIT / max(1, n))))) for s, n in counts.items()], "source string, part_ long")
    labelled = documents.where(F.col("text").isNotNull()).join(kept, "source").where(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) < F.col("part_")).select("text", "source")
    found = labelled.mapInArrow(_bucket_counts(vocabulary, sources, buckets), "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()  # a model's size
    table = np.full((len(sources), buckets), 0.5)
    table[found["row"].to_numpy(), found["bucket"].to_numpy()] += found["n"].to_numpy()
    prior = np.array([counts[s] + 0.5 for s in sources])
    return np.column_stack([np.log(table / table.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())]).astype(np.float32)


def posterior(ids: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Posteriors over the sources of a text with these token ids."""
    score = model[:, -1].astype(float)
    if len(ids):
        used = features(ids, model.shape[1] - 1)
        score += model[:, used].sum(axis=1, dtype=float) * min(1.0, EVIDENCE / len(used))
    score = np.exp(score - score.max())
    return score / score.sum()


def _members(path: str, sources: Sequence[str], model):
    index = {s: i for i, s in enumerate(sources)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, weights = encoding(path).encode_ordinary, model.value
        for batch in batches:
            tokens, soft, own = [], [], []
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist()):
                ids = encode(text or "")
                tokens.append(len(ids))
                p = None if source is not None else posterior(np.array(ids, dtype=np.int64), weights)
                soft.append(p)
                own.append(index[source] if p is None else int(np.argmax(p)))
            columns = [batch.column(0), batch.column("source"), pa.array(own, pa.int32()), pa.array(tokens, pa.int64()), pa.array(soft, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "source", "own", "tokens", "soft"])

    return task


@dataclass
class Members:
    """Arrays of some documents: source or likeliest source, tokens, and the rows that have a soft membership, with it."""

    own: np.ndarray
    tokens: np.ndarray
    rows: np.ndarray
    soft: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, sources: int) -> Members:
        column = pa.table({"x": table["soft"]})["x"].combine_chunks()
        rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
        return Members(ints(table["own"], 0), ints(table["tokens"], 0).astype(float), rows, flat.reshape(-1, sources))

    def rates(self, moves: np.ndarray, cap: float) -> np.ndarray:
        """Rates after the passes so far. ``moves``: passes x sources, what a pass takes from the rate of a full member."""
        r = np.zeros(len(self.own))
        for move in moves:
            down = move[self.own]
            down[self.rows] = self.soft @ move
            r = np.clip(r - down, 0.0, cap)
        return r

    def totals(self, weight: np.ndarray, sources: int) -> np.ndarray:
        """Sums of ``weight`` by membership."""
        hard = weight.copy()
        hard[self.rows] = 0.0
        return np.bincount(self.own, weights=hard, minlength=sources) + weight[self.rows] @ self.soft


def _totals(moves: dict[str, np.ndarray], caps: dict[str, float], sources: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(sources) for m in moves}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = Members.of(batch, sources)
            for mix, path in moves.items():
                sums[mix] += part.totals(part.tokens * part.rates(path, caps[mix]), sources)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["mix", "sums"])

    return task


def _sum_totals(members: DataFrame, moves: dict[str, np.ndarray], caps: dict[str, float], sources: int) -> dict[str, np.ndarray]:
    """Per mix the expected tokens of each source: one pass."""
    parts = members.mapInArrow(_totals(moves, caps, sources), "mix string, sums array<double>").select("mix", F.posexplode("sums").alias("i", "v"))
    out = {m: np.zeros(sources) for m in moves}
    for m, i, v in parts.groupBy("mix", "i").agg(F.sum("v")).collect():
        out[m][i] = v
    return out


def _copies(moves: dict[str, np.ndarray], caps: dict[str, float], sources: int, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, ["shard"]):
            part = Members.of(table, sources)
            own, tokens = part.own, part.tokens
            for mix, path in moves.items():
                r = part.rates(path, caps[mix])
                low, chosen = np.floor(r + 1e-9), np.zeros(len(r), dtype=np.int64)
                for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    debt = [0.0] * sources
                    for i in range(begin, end):  # longest first: the last, short ones settle what is owed
                        s, t = own[i], tokens[i]
                        debt[s] += (r[i] - low[i]) * t
                        up = r[i] > low[i] + 1e-9 and debt[s] >= t / 2
                        debt[s] -= t * up
                        chosen[i] = int(low[i]) + up
                rows = np.flatnonzero(chosen > 0)
                picked = table.take(pa.array(rows))
                columns = [pa.array([mix] * len(rows)), picked["key"], picked["source"], picked["own"], pa.array(chosen[rows].astype(np.int32)), pa.array(r[rows]), picked["tokens"]]
                yield from pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()

    return task


def mix_sources(documents: DataFrame, key: str, text: str, source: str, mixes: Sequence[Mix], *, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses: mix_name, ``key``, source, predicted (a bool: the source is the classifier's), copies, rate and tokens of each
    document used. shares: mix_name, source, target_share, actual_share, target_tokens, tokens, expected_tokens (by membership, before rates become
    copies), documents, most_copies, limited (the source has too few tokens for its target, even with every document used max_repeats times) and
    settled (of the mix: the passes ended because nothing moved).

    Targets are size_ratio times the tokens of all documents, by target share. A source that cannot reach its target gives all it may; the
    others keep theirs, so the total falls short by as much, and shares say what came out. A wished source without documents supplies nothing;
    documents of an unwished source are not used. Documents without a source are members of each source as far as they read like it, and
    their tokens are reported for the likeliest. Null, empty and blank texts without tokens are never used. Repeated rows are documents of their own.
    Mixes without documents give shares of zero. Extra columns are ignored. Names of sources go to the driver; more than ``MODEL_BYTES`` allows raise.
    """
    path = vocabulary or default_vocabulary()
    docs = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")))
    counts = {r[0]: r[1] for r in docs.where(F.col("source").isNotNull()).groupBy("source").count().orderBy("source").collect()} or {"unknown": 0}
    names, n = list(counts), len(counts)
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit_classifier(docs, counts, path))  # at most MODEL_BYTES
    schema = StructType([StructField("key", documents.schema[key].dataType), StructField("source", StringType()), StructField("own", IntegerType()), StructField("tokens", LongType()), StructField("soft", ArrayType(DoubleType()))])
    members = cut(docs.mapInArrow(_members(path, names, model), schema).where("tokens > 0"))
    caps = {m.name: float(m.max_repeats) for m in mixes}

    have = _sum_totals(members, {"all": np.full((1, n), -1.0)}, {"all": 1.0}, n)["all"]  # the totals at rate one
    size = float(have.sum())
    targets = {m.name: np.array([m.shares.get(s, 0.0) * m.size_ratio * size for s in names]) for m in mixes}
    moves = {m.name: np.zeros((0, n)) for m in mixes}
    sums = {m.name: np.zeros(n) for m in mixes}
    settled = {m.name: False for m in mixes}
    for _ in range(PASSES if mixes else 0):
        for m in mixes:
            down = np.divide(sums[m.name] - targets[m.name], have, out=np.zeros(n), where=have > 0)
            moves[m.name] = np.concatenate([moves[m.name], down[None]])
        new = _sum_totals(members, moves, caps, n)
        for m in mixes:
            settled[m.name] = float(np.abs(new[m.name] - sums[m.name]).max()) <= SETTLED * max(1.0, float(targets[m.name].sum()))
        sums = new
        if all(settled.values()):
            break
    rows = members.count()
    shards = max(1, -(-rows // SHARD))
    placed = members.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    out = StructType(
        [StructField("mix_name", StringType()), StructField("key", documents.schema[key].dataType), StructField("source", StringType()), StructField("own", IntegerType())]
        + [StructField("copies", IntegerType()), StructField("rate", DoubleType()), StructField("tokens", LongType())]
    )
    used = co_sorted(placed, ["shard"], [F.desc("tokens"), "key"]).mapInArrow(_copies(moves, caps, n, to_arrow_schema(out)), out)
    label = F.element_at(F.array(*map(F.lit, names)), F.col("own") + 1)
    uses = used.select("mix_name", F.col("key").alias(key), label.alias("source"), F.col("source").isNull().alias("predicted"), "copies", "rate", "tokens")
    at = {s: i for i, s in enumerate(names)}
    wanted = [
        (m.name, s, float(share), float(share * m.size_ratio * size), float(sums[m.name][at[s]]) if s in at else 0.0, s not in at or bool(share * m.size_ratio * size > caps[m.name] * have[at[s]]), settled[m.name])
        for m in mixes for s, share in sorted(m.shares.items())
    ]
    want = spark.createDataFrame(wanted, "mix_name string, source string, target_share double, target_tokens double, expected_tokens double, limited boolean, settled boolean")
    got = uses.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    all_of = got.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    joined = want.join(got, ["mix_name", "source"], "left").join(all_of, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = joined.select(
        "mix_name", "source", "target_share", F.coalesce(zero("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "target_tokens",
        zero("tokens").alias("tokens"), "expected_tokens", zero("documents").alias("documents"), zero("most_copies").alias("most_copies"), "limited", "settled",
    )
    return uses, shares

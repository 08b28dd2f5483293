"""Filling fixed-capacity containers.

Method: vector bin packing by the dot-product heuristic. A container has limits on tokens, on segments and on loss-bearing tokens. While
one is open, the item that fits and has the greatest dot product of its sizes with the room left, each as a share of its limit, is placed;
when none fits it is closed. Only an item beyond the token capacity is split, into full pieces, each a container of its own, and a rest.
Where a kind's loss limit is below its capacity, an item whose own loss exceeds it is a container of its own, too.

Items are packed in shards of bounded size, spread by hash, so no source or length makes a shard large. What lies in containers that a shard
left under ``GOOD`` full is packed again in fewer shards; rounds end when one shard remains. Equal sizes share one line of the tables
in a shard, which is what the work of a step grows with.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quoin.operators.runs import co_sorted, ints, key_runs
from quoin.session import cut

#: Items of a shard, roughly; fill from which a container stays as it is.
SHARD, GOOD = 8_000, 0.98


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; ``sizes``: items x limits, none beyond ``limits``.

    Items of equal sizes are one shape; shapes lie in order of their first size, so those that fit by it are a prefix, which a step reads without
    copying it. Shapes used up are marked, and dropped once they are half of all."""
    shapes, shape_of = np.unique(sizes, axis=0, return_inverse=True)
    shape_of = shape_of.reshape(-1)
    order = np.argsort(shape_of, kind="stable")
    stop = np.cumsum(np.bincount(shape_of, minlength=len(shapes)))
    taken = np.concatenate([[0], stop[:-1]])
    out = np.full(len(sizes), -1, dtype=np.int64)
    limits = np.asarray(limits, dtype=float)
    rest = range(1, len(limits))
    left, container, live, dead = len(sizes), 0, np.arange(len(shapes)), 0
    columns = [np.ascontiguousarray(c, dtype=float) for c in shapes.T]
    shares = [c / m for c, m in zip(columns, limits)]
    most, gone = [np.maximum.accumulate(c) for c in columns], np.zeros(len(shapes))
    vary = [j for j, c in enumerate(columns) if len(c) and c.min() != c.max()]  # what is the same for all decides nothing
    while left:
        room = limits.copy()
        while True:
            n = int(np.searchsorted(columns[0], room[0] + 1e-9, "right"))
            if not n:
                break
            score = gone[:n].copy()
            for j in vary:
                score += shares[j][:n] * (room[j] / limits[j])
            for j in rest:
                if most[j][n - 1] > room[j] + 1e-9:
                    score[columns[j][:n] > room[j] + 1e-9] = -np.inf
            best = int(np.argmax(score))
            if score[best] == -np.inf:
                break
            shape = live[best]
            out[order[taken[shape]]] = container
            taken[shape] += 1
            left -= 1
            for j in range(len(limits)):
                room[j] -= columns[j][best]
            if taken[shape] == stop[shape]:
                gone[best] = -np.inf
                dead += 1
        container += 1
        if 2 * dead > len(live):
            keep = gone == 0
            live, gone, dead = live[keep], gone[keep], 0
            columns, shares = [c[keep] for c in columns], [c[keep] for c in shares]
            most = [np.maximum.accumulate(c) for c in columns]
    return out


def _pack_runs(limits: Mapping[str, tuple[int, int, int]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in key_runs(batches, ["kind", "shard"]):
            tokens, loss = ints(table["tokens"], 0), ints(table["loss"], 0)
            kinds = table["kind"].to_pylist()
            number, filled = np.zeros(table.num_rows, dtype=np.int64), np.zeros(table.num_rows, dtype=np.int64)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sizes = np.column_stack([tokens[low:high], np.ones(high - low, dtype=np.int64), loss[low:high]])
                own = pack(sizes, np.array(limits[kinds[low]]))
                number[low:high] = own
                filled[low:high] = np.bincount(own, weights=tokens[low:high]).astype(np.int64)[own]
            out = table.select(["kind", "shard", "key", "piece", "from_token", "tokens", "loss"]).append_column("number", pa.array(number)).append_column("filled", pa.array(filled))
            yield from out.combine_chunks().to_batches()

    return task


def pack_containers(items: DataFrame, key: str, tokens: str, loss: str, limits: Mapping[str, tuple[int, int, int]], *, shard: int = SHARD, alone: bool = False) -> DataFrame:
    """Every item in containers of every kind: container_kind, container_id, ``key``, piece, from_token, tokens, loss_tokens.

    ``limits``: kind -> (tokens, segments, loss-bearing tokens) at most. If the last is under the first, an item within the capacity can bear
    more loss than is allowed: that raises, unless ``alone``, with which such an item, or full piece, is a container of its own, the only
    kind of container beyond its loss limit. ``loss`` tokens of an item are its last ones and are cut to its tokens. Pieces of one item number
    from 0 in text order. Items without tokens (null, zero or below) need no room and come in no container. Keys should be unique: two items of
    one key are placed apart but cannot be told from each other. An empty table or no kinds give no containers. Extra columns are ignored.
    """
    for kind, (most, segments, losses) in limits.items():
        if most < 1 or segments < 1 or losses < (1 if alone else most):
            raise ValueError(f"impossible limits for {kind}: {(most, segments, losses)}")
    spark = items.sparkSession
    size = F.col("tokens")
    own = items.select(F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"), F.greatest(F.lit(0), F.least(F.coalesce(F.col(loss).cast("long"), F.lit(0)), F.col(tokens).cast("long"))).alias("loss"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v[0]).cast("long").alias("capacity"), F.lit(v[2]).cast("long").alias("bearing")) for k, v in limits.items()))
    if not limits:
        kinds = F.array().cast("array<struct<kind:string,capacity:bigint,bearing:bigint>>")
    pieces = own.where("tokens > 0").withColumn("k", F.explode(kinds)).select("key", "tokens", "loss", "k.*")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    part = F.least(size - start, F.col("capacity"))
    pieces = pieces.select(
        "kind", "capacity", "bearing", "key", "piece", start.alias("from_token"), part.alias("tokens"),
        F.greatest(F.lit(0), start + part - F.greatest(size - F.col("loss"), start)).alias("loss"),
    )
    pieces = pieces.withColumn("why", F.when(F.col("tokens") == F.col("capacity"), "full").when(F.col("loss") > F.col("bearing"), "alone"))
    own = pieces.where("why IS NOT NULL")
    done = own.select("kind", F.concat_ws("-", "kind", "why", F.col("key").cast("string"), F.col("piece").cast("string"), F.xxhash64("key").cast("string")).alias("id"), "key", "piece", "from_token", "tokens", "loss")
    rest = pieces.where("why IS NULL").drop("capacity", "bearing", "why")
    schema = StructType(
        [StructField("kind", StringType()), StructField("shard", IntegerType()), StructField("key", items.schema[key].dataType), StructField("piece", IntegerType())]
        + [StructField(c, LongType()) for c in ("from_token", "tokens", "loss", "number", "filled")]
    )
    least = spark.createDataFrame([(k, int(GOOD * v[0])) for k, v in limits.items()], "kind string, least long") if limits else None
    count, turn = (rest.groupBy("kind").count().agg(F.max("count")).first()[0] or 0), 0
    while count:
        shards = max(1, -(-count // shard))
        placed = rest.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(turn)), F.lit(shards)).cast("int"))
        packed = cut(co_sorted(placed, ["kind", "shard"], ["key", "piece"]).mapInArrow(_pack_runs(dict(limits)), schema).join(F.broadcast(least), "kind"))
        name = F.concat_ws("-", "kind", F.lit(str(turn)), F.col("shard").cast("string"), F.col("number").cast("string")).alias("id")
        good = packed if shards == 1 else packed.where("filled >= least")
        done = done.unionByName(good.select("kind", name, "key", "piece", "from_token", "tokens", "loss"))
        if shards == 1:
            break
        rest = packed.where("filled < least").select("kind", "key", "piece", "from_token", "tokens", "loss")
        left = rest.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
        # a round that frees too little ends the search: what remains is packed as it is
        if left > 0.7 * count and turn:
            done = done.unionByName(packed.where("filled < least").select("kind", name, "key", "piece", "from_token", "tokens", "loss"))
            break
        count, turn = left, turn + 1
    return done.select(F.col("kind").alias("container_kind"), F.col("id").alias("container_id"), F.col("key").alias(key), "piece", "from_token", "tokens", F.col("loss").alias("loss_tokens"))

import random
from collections import defaultdict

import numpy as np
import pytest

from quoin.llm.packing import pack, pack_containers
from quoin.llm.queries import container_limits, p8_containers
from quoin.llm.tokens import default_vocabulary, encoding, token_counts
from quoin.session import table

LIMITS = {"small": (100, 8, 100), "large": (400, 10, 400)}


def fill(spark, rows, shard=8_000, limits=LIMITS):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc long, tokens long, loss long, kind string")
    return [r.asDict() for r in pack_containers(frame, "doc", "tokens", "loss", limits, shard=shard).collect()]


def check(rows, out, limits=LIMITS):
    """Every token of every item once per kind, no limit exceeded, no needless split."""
    boxes = defaultdict(list)
    for r in out:
        boxes[r["container_kind"], r["container_id"]].append(r)
    for (kind, _), inside in boxes.items():
        tokens, segments, loss = limits[kind]
        assert sum(r["tokens"] for r in inside) <= tokens and len(inside) <= segments and sum(r["loss_tokens"] for r in inside) <= loss
    for kind, (most, _, _) in limits.items():
        for doc, n, loss in {r for r in rows if r[1] and r[1] > 0}:
            parts = sorted((r["from_token"], r["tokens"], r["loss_tokens"]) for r in out if r["container_kind"] == kind and r["doc"] == doc)
            assert len(parts) == -(-n // most), (kind, doc)
            assert [p[0] for p in parts] == [most * i for i in range(len(parts))] and sum(p[1] for p in parts) == n
            assert sum(p[2] for p in parts) == max(0, min(loss or 0, n))
    return boxes


@pytest.mark.parametrize("shard", [8_000, 60])
def test_whole_contents_within_limits_and_nearly_full(spark, shard):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 90), rng.randrange(90, 950)]), rng.randrange(0, 80)) for i in range(400)]
    out = fill(spark, rows, shard)
    boxes = check(rows, out)
    tokens = sum(r[1] for r in rows)
    n = sum(1 for kind, _ in boxes if kind == "small")
    assert tokens / (100 * n) > 0.9


def test_nulls_zeroes_ties_exact_sizes_and_empty(spark):
    rows = [(1, 100, 5), (2, 50, None), (3, 50, 70), (4, 0, 0), (5, None, 3), (6, 200, 0), (7, -4, 0), (8, 401, 401)]
    check(rows, fill(spark, rows))
    assert fill(spark, []) == [] and fill(spark, rows, limits={}) == []
    with pytest.raises(ValueError):
        fill(spark, rows, limits={"bad": (100, 0, 100)})
    with pytest.raises(ValueError):
        fill(spark, rows, limits={"bad": (100, 4, 60)})


def test_segment_limit_binds():
    sizes = np.column_stack([np.ones(50, dtype=int), np.ones(50, dtype=int), np.ones(50, dtype=int)])
    assert max(np.bincount(pack(sizes, np.array([100, 8, 100])))) == 8


def closed_by(sizes, own, limits):
    """Containers of each limit that some item packed later would have joined, were it not for that limit alone."""
    out = [0] * len(limits)
    for c in range(own.max() + 1):
        over = sizes[own > c] > limits - sizes[own == c].sum(axis=0)
        for i in range(len(limits)):
            out[i] += bool(np.any(over[:, i] & (over.sum(axis=1) == 1)))
    return out


def test_a_loss_limit_below_the_capacity_binds_and_greater_losses_stay_alone(spark):
    rng = random.Random(5)
    rows = [(i, n, rng.randrange(0, n + 1)) for i in range(300) for n in [rng.randrange(1, 100)]] + [(300, 60, 60), (301, 61, 61), (302, 250, 250), (303, 100, 20)]
    frame = spark.createDataFrame(rows, "doc long, tokens long, loss long")
    out = [r.asDict() for r in pack_containers(frame, "doc", "tokens", "loss", {"k": (100, 4, 60)}, alone=True).collect()]
    boxes = defaultdict(list)
    for r in out:
        boxes[r["container_id"]].append(r)
    for inside in boxes.values():
        assert sum(r["tokens"] for r in inside) <= 100 and len(inside) <= 4
        assert sum(r["loss_tokens"] for r in inside) <= 60 or len(inside) == 1
    assert sorted((r["doc"], r["from_token"], r["tokens"], r["loss_tokens"]) for r in out if r["doc"] != 302) == sorted((d, 0, n, loss) for d, n, loss in rows if d != 302)
    assert sorted((r["from_token"], r["tokens"], r["loss_tokens"]) for r in out if r["doc"] == 302) == [(0, 100, 100), (100, 100, 100), (200, 50, 50)]
    assert sum(len(b) for b in boxes.values() if len(b) > 1) > 200


def test_each_limit_of_the_query_closes_containers_of_documents(spark):
    path = "/root/testdata/sf0.01"
    for r in table(spark, path, "pack_capacity").collect():
        limits = np.array(container_limits(r["capacity_tokens"]))
        counts = token_counts(table(spark, path, "documents"), "doc_id", "text").selectExpr("tokens", "tokens - prompt_tokens").where(f"tokens > 0 AND tokens < {limits[0]}").collect()
        sizes = np.array([(n, 1, loss) for n, loss in counts if loss <= limits[2]])
        assert min(closed_by(sizes, pack(sizes, limits), limits)) > 0, r


def test_containers_of_documents_keep_all_three_limits(spark, data):
    limits = {r["container_kind"]: container_limits(r["capacity_tokens"]) for r in table(spark, data, "pack_capacity").collect()}
    boxes = defaultdict(list)
    for r in p8_containers(spark, data).collect():
        boxes[r["container_kind"], r["container_id"]].append(r)
    for (kind, _), inside in boxes.items():
        tokens, segments, loss = limits[kind]
        assert sum(r["tokens"] for r in inside) <= tokens and len(inside) <= segments
        assert sum(r["loss_tokens"] for r in inside) <= loss or len(inside) == 1


def test_no_worse_than_first_fit_decreasing():
    rng = np.random.default_rng(2)
    tokens = rng.integers(5, 70, 600)
    own = pack(np.column_stack([tokens, np.ones(600, dtype=int), tokens]), np.array([100, 50, 100])).max() + 1
    rooms: list[int] = []
    for t in sorted(tokens, reverse=True):
        for i, r in enumerate(rooms):
            if r >= t:
                rooms[i] -= t
                break
        else:
            rooms.append(100 - t)
    assert own <= len(rooms) * 1.02 + 1


def test_counts_are_the_tokenizers(spark):
    texts = [None, "", "one line", "Head: é\nbody <|endoftext|> text", "\n\n", "word " * 30_000]
    out = {r["doc"]: (r["tokens"], r["prompt_tokens"]) for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), "doc", "text").collect()}
    encode = encoding(default_vocabulary()).encode_ordinary
    assert [out[i][0] for i in range(6)] == [len(encode(t or "")) for t in texts]
    assert out[2][1] == 0 and out[3][1] == len(encode("Head: é\n")) and out[5][1] == 0

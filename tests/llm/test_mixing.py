import random

import pytest

from quoin.llm.mixing import Mix, mix_sources

WORDS = {"a": "alpha amber apple anchor", "b": "bravo birch bronze beacon", "c": "cobalt cedar copper candle"}
SCHEMA = "doc long, text string, source string, copies int"


def documents(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices("abc", (6, 3, 1))[0]
        words = WORDS[source].split() + ["the", "report", "says"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))), source, 1))
    return rows


def run(spark, rows, mixes):
    uses, shares = mix_sources(spark.createDataFrame(rows, SCHEMA), "doc", "text", "source", mixes)
    return [r.asDict() for r in uses.collect()], {(r["mix_name"], r["source"]): r.asDict() for r in shares.collect()}


def test_shares_and_size_come_out(spark):
    rows = documents()
    mix = Mix("m", {"a": 0.4, "b": 0.4, "c": 0.2}, 4, 0.8)
    uses, shares = run(spark, rows, [mix])
    for s, share in mix.shares.items():
        assert abs(shares["m", s]["actual_share"] - share) < 0.01
        assert not shares["m", s]["limited"]
    assert all(1 <= u["copies"] <= 4 for u in uses) and len({u["doc"] for u in uses}) == len(uses)
    total = sum(u["copies"] * u["tokens"] for u in uses)
    assert total == sum(s["tokens"] for s in shares.values())
    assert abs(total - sum(s["target_tokens"] for s in shares.values())) < 0.01 * total


def test_small_absent_and_unwished_sources(spark):
    rows = documents()
    uses, shares = run(spark, rows, [Mix("m", {"c": 0.6, "a": 0.3, "zz": 0.1}, 2, 1.0)])
    assert shares["m", "zz"]["tokens"] == 0 and shares["m", "zz"]["limited"]
    assert shares["m", "c"]["limited"] and shares["m", "c"]["most_copies"] == 2
    assert {u["copies"] for u in uses if u["source"] == "c"} == {2}
    assert not [u for u in uses if u["source"] == "b"]
    assert abs(shares["m", "a"]["tokens"] - shares["m", "a"]["target_tokens"]) < 0.02 * shares["m", "a"]["target_tokens"]


def test_documents_without_a_source_go_where_they_read_like(spark):
    rows = documents() + [(1000 + i, "bravo birch bronze beacon birch bravo beacon", None, 1) for i in range(20)]
    uses, _ = run(spark, rows, [Mix("m", {"a": 0.3, "b": 0.7}, 5, 1.0)])
    guessed = [u for u in uses if u["predicted"]]
    assert guessed and {u["source"] for u in guessed} == {"b"}


def test_nulls_blanks_repeats_empty_and_no_mixes(spark):
    rows = documents(60) + [(500, None, "a", 1), (501, "", "b", 1), (502, "alpha", "a", 1), (502, "alpha", "a", 1)]
    uses, _ = run(spark, rows, [Mix("m", {"a": 1.0}, 1, 0.3)])
    assert not {500, 501} & {u["doc"] for u in uses}
    uses, shares = run(spark, [], [Mix("m", {"a": 1.0}, 1, 1.0)])
    assert uses == [] and shares["m", "a"]["actual_share"] == 0
    assert run(spark, documents(50), []) == ([], {})


def test_soft_members_count_for_each_source_as_far_as_they_read_like_it(spark):
    """Documents that read half like a and half like b, more of them than there are labelled ones: the expected totals must still meet the targets."""
    rng = random.Random(4)
    words = {s: WORDS[s].split() for s in "ab"}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(20)), "ab"[i % 2], 1) for i in range(80)]
    rows += [(1000 + i, " ".join(rng.choice(words["a"]) + " " + rng.choice(words["b"]) for _ in range(10)), None, 1) for i in range(200)]
    uses, shares = run(spark, rows, [Mix("m", {"a": 0.7, "b": 0.3}, 3, 0.4)])
    for s in "ab":
        assert shares["m", s]["expected_tokens"] == pytest.approx(shares["m", s]["target_tokens"], rel=1e-4) and shares["m", s]["settled"]
    assert len({round(u["rate"], 6) for u in uses if u["predicted"]}) > 2  # rates follow memberships, not labels


def test_the_model_keeps_its_size():
    from quoin.llm.mixing import BUCKETS, MODEL_BYTES, buckets_for

    assert buckets_for(20) == BUCKETS and all(buckets_for(n) * n * 4 <= MODEL_BYTES for n in (20, 2_000, 60_000))
    with pytest.raises(ValueError):
        buckets_for(1_000_000)

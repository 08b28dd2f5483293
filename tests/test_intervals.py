import random
from datetime import datetime, timedelta

import pytest

from quoin.operators.intervals import IntervalMap, OpenIntervals, _slabs, interval_map
from quoin.operators.slabs import slab_bounds

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, fact long, a timestamp, b timestamp, kind string, slab_no int"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def brute(rows):
    """Pairs and gaps per key, from the definition."""
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        own = {(r[1], r[2], r[3] if r[3] is not None else 10**6) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and (r[3] is None or r[3] > r[2])}
        own = sorted(own)
        for i, (f, s, e) in enumerate(own):
            for g, t, u in own[i + 1 :]:
                if f != g and s < u and t < e:
                    out.add((k, "overlap", min(f, g), max(f, g)))
        for _, _, e in own:
            later = [s for _, s, _ in own if s > e]
            if later and not any(s <= e < u for _, s, u in own):
                n = min(later)
                a, b = min(f for f, _, u in own if u == e), min(f for f, s, _ in own if s == n)
                out.add((k, "gap", min(a, b), max(a, b)))
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(k, f, at(a), at(b), "x", 1) for k, f, a, b in rows], SCHEMA)
    return interval_map(frame, ["k"], "a", "b", "fact", **options)


def pairs(df):
    return {(r["k"], r["kind"], r["id_1"], r["id_2"]) for r in df.where("kind <> 'period'").collect()}


def periods(df):
    return sorted((r["k"], r["t_start"], r["t_end"] or datetime.max) for r in df.where("kind = 'period'").collect())


def random_rows(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(400)
        out.append((rng.choice("aab"), i, a, rng.choice([None, a, a - 3] if rng.random() < 0.08 else [a + rng.randrange(1, 9)])))
    return out + out[:20]


@pytest.mark.parametrize("limit", [10**6, 25])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_gaps_as_defined_whatever_the_slabs(spark, seed, limit):
    rows = random_rows(seed)
    assert pairs(found(spark, rows, limit=limit)) == brute(rows)


def test_slabs_do_not_change_periods(spark):
    rows = random_rows(3, 300)
    assert periods(found(spark, rows, limit=20)) == periods(found(spark, rows))


def test_touching_intervals_join_without_overlap(spark):
    out = found(spark, [("a", 1, 0, 5), ("a", 2, 5, 9), ("a", 3, 12, None)])
    assert pairs(out) == {("a", "gap", 2, 3)}
    assert [(s, e) for _, s, e in periods(out)] == [(at(0), at(9)), (at(12), datetime.max)]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [("a", 1, 0, 4), ("a", 1, 0, 4), ("a", 2, 0, 4), (None, 3, 0, 4), ("a", None, 0, 4), ("a", 4, None, 4), ("a", 5, 3, 3), ("a", 6, 3, 1)]
    assert pairs(found(spark, rows)) == {("a", "overlap", 1, 2)}
    assert found(spark, []).count() == 0


def test_map_is_the_same_in_any_order():
    rng = random.Random(5)
    items = [(s := rng.randrange(200), s + rng.randrange(1, 6), i) for i in range(80)]
    results = set()
    for _ in range(5):
        rng.shuffle(items)
        m = IntervalMap()
        for s, e, i in items:
            m.insert(s, e, i)
        results.add((tuple(m.starts), tuple(m.ends), tuple(m.first), tuple(m.last)))
        assert all(a < b for a, b in zip(m.ends, m.starts[1:]))
    assert len(results) == 1


@pytest.mark.parametrize("pairs", [True, False])
def test_slabs_hold_what_their_limit_says(spark, pairs):
    """Half of the intervals open-ended, and a time that holds a third of all rows."""
    rows = [("a", i, 5 if i % 3 == 0 else i // 4, None if i % 2 else i // 4 + 7) for i in range(400)]
    frame = spark.createDataFrame([(k, f, a * 10**6, None if b is None else b * 10**6) for k, f, a, b in rows], "k string, id_1 long, t_start long, t_end long")
    bounds = slab_bounds(frame, ["k"], "t_start", "id_1", 40)
    sizes = _slabs(frame, bounds, ["k"], pairs, 40).groupBy("slab_no", "chunk_no", "role").count().collect()
    assert max(r["count"] for r in sizes) <= 60 and len({r["slab_no"] for r in sizes}) >= 8
    if not pairs:
        assert sum(r["count"] for r in sizes) <= 400 + len(sizes)


def test_all_starts_equal_are_cut_by_id(spark):
    rows = [("a", i, 3, 4 + i % 5) for i in range(60)]
    assert pairs(found(spark, rows, limit=10)) == brute(rows)
    frame = spark.createDataFrame([("a", i, 3) for i in range(1000)], "k string, i long, t long")
    (row,) = slab_bounds(frame, ["k"], "t", "i", 100).collect()
    assert len(row["bounds"]) >= 9


def test_one_open_interval_does_not_make_insertion_quadratic():
    import time

    live, began, n = OpenIntervals(), time.perf_counter(), 200_000
    live.add(2**62, 0)
    assert sum(len(live.close(3 * i)) + (live.add(3 * i + 1, i) or 0) for i in range(1, n)) == n - 1
    assert time.perf_counter() - began < 20

import random
from datetime import datetime, timedelta

import pytest

from quoin.operators.known import LIMIT, PersistentTree, as_known

T0 = datetime(2024, 1, 1)
FACTS = "k string, m string, v double, kf timestamp, vf timestamp, vt timestamp, id long, side int"
EVENTS = "k string, e long, kt timestamp, vt timestamp, side int"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def run(spark, events, facts, limit=10**6, same=False):
    e = spark.createDataFrame([(k, i, at(a), at(b), 0) for k, i, a, b in events], EVENTS)
    f = spark.createDataFrame([(k, m, v, at(a), at(b), at(c), i, 0) for k, m, v, a, b, c, i in facts], FACTS)
    return as_known(e, f, ["k"], ["x", "y"], event_known="kt", event_valid="kt" if same else "vt", attribute="m", known="kf", valid_from="vf", valid_to="vt", value="v", fact_id="id", limit=limit)


def brute(events, facts, same=False):
    out = []
    for k, e, kt, vt in events:
        vt = kt if same else vt
        row = [k, e]
        for m in ("x", "y"):
            ok = [f for f in facts if None not in (k, kt, vt, f[0], f[1], f[3], f[4], f[6]) and f[0] == k and f[1] == m and f[3] <= kt and f[4] <= vt and (f[5] is None or f[5] > vt)]
            best = max(ok, key=lambda f: (f[4], f[3], f[6]), default=None)
            row += [best and best[2], best and best[6]]
        out.append(tuple(row))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["k"], r["e"], r["known_x"], r["fact_x"], r["known_y"], r["fact_y"]) for r in df.collect()), key=str)


def make(seed, n=200, same=False):
    rng = random.Random(seed)
    facts, events = [], []
    for i in range(n):
        kf = rng.randrange(300)
        vf = kf if same else kf + rng.randrange(-20, 20)
        facts.append((rng.choice("aaab"), rng.choice("xyz"), float(i), kf, vf, rng.choice([None, vf + rng.randrange(-2, 60)]), i))
        events.append((rng.choice("aaab"), i, rng.randrange(320), rng.randrange(320)))
    return events, facts


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("limit", [10**6, 40])
def test_latest_valid_fact_known_then(spark, limit, same):
    events, facts = make(1, same=same)
    assert rows(run(spark, events, facts, limit, same)) == brute(events, facts, same)


def test_later_knowledge_never_leaks(spark):
    facts = [("a", "x", 1.0, 0, 0, None, 1), ("a", "x", 2.0, 10, 0, None, 2)]
    assert rows(run(spark, [("a", 1, 9, 50), ("a", 2, 10, 50)], facts)) == [("a", 1, 1.0, 1, None, None), ("a", 2, 2.0, 2, None, None)]


def test_nulls_repeats_and_empty_sides(spark):
    facts = [("a", "x", None, 0, 0, None, 1), ("a", "x", None, 0, 0, None, 1), (None, "x", 3.0, 0, 0, None, 2), ("a", None, 3.0, 0, 0, None, 3), ("a", "y", 3.0, None, 0, None, 4)]
    events = [("a", 1, 5, 5), ("a", 1, 5, 5), (None, 2, 5, 5), ("a", 3, None, 5)]
    assert rows(run(spark, events, facts)) == sorted([("a", 1, None, 1, None, None)] * 2 + [(None, 2, None, None, None, None), ("a", 3, None, None, None, None)], key=str)
    assert run(spark, [], facts).count() == 0
    assert rows(run(spark, [("a", 1, 1, 1)], [])) == [("a", 1, None, None, None, None)]


def test_clashing_names_raise(spark):
    e = spark.createDataFrame([("a", 1, T0, T0, 5)], "k string, e long, kt timestamp, vt timestamp, known_x int")
    f = spark.createDataFrame([], FACTS)
    with pytest.raises(ValueError):
        as_known(e, f, ["k"], ["x"], event_known="kt", event_valid="vt", attribute="m", known="kf", valid_from="vf", valid_to="vt", value="v", fact_id="id")


def test_old_versions_stay_readable():
    tree = PersistentTree()
    for i in range(500):
        tree.insert(i, (i * 37) % 500, 10**9, i)
    for known in (0, 17, 250, 499):
        want = max(((i * 37) % 500, i) for i in range(known + 1))
        assert tree.at(known, 10**6) == want[1]
    assert tree.at(-1, 5) is None


def test_facts_and_events_of_one_time_are_cut_too(spark):
    facts = [("a", "x", float(i), 7, 7, None if i % 3 else 50, i) for i in range(90)] + [("a", "x", 900.0, 20, 20, 30, 900)]
    events = [("a", i, 7 + 4 * (i % 7), 0) for i in range(120)]
    assert rows(run(spark, events, facts, 25, True)) == brute(events, facts, True)


def test_a_full_slab_fits_in_memory():
    tree, n = PersistentTree(), LIMIT // 4
    for i in range(n):
        tree.insert(i, (i * 7919) % n, 10**9, i)
    size = sum(part.itemsize * len(part) for part in (tree.fact, tree.left, tree.right, tree.most, tree.valid, tree.until, tree.ids, tree.rank))
    assert size * 4 * 1.2 < 200e6

import numpy as np
import pytest

from tracewright.operators import matching as m


def naive(left, right, tol):
    pairs = sorted((abs(x - y), i, j) for i, x in left for j, y in right if abs(x - y) <= tol)
    used_l, used_r, out = set(), set(), set()
    for d, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.add((i, j))
    return out


def run(spark, left, right, tol, small=0):
    l = spark.createDataFrame([("s", i, float(x)) for i, x in left] or [("s", -1, None)], "k string, i long, x double")
    r = spark.createDataFrame([("s", j, float(y)) for j, y in right] or [("s", -1, None)], "k string, j long, y double")
    return {(g.i, g.j) for g in m.greedy_match(l, r, ["k"], "x", "y", "i", "j", tol, small_rows=small).collect()}


@pytest.mark.parametrize("small", [0, 9, 2000])
def test_greedy_equals_the_sequential_walk(spark, small):
    """Many small integer cases, full of ties, matched together as separate keys."""
    rng = np.random.default_rng(11)
    cases = [(rng.integers(0, 30, rng.integers(0, 10)), rng.integers(0, 30, rng.integers(0, 10))) for _ in range(150)]
    l = spark.createDataFrame([(k, i, float(x)) for k, (xs, _) in enumerate(cases) for i, x in enumerate(xs)], "k long, i long, x double")
    r = spark.createDataFrame([(k, j, float(y)) for k, (_, ys) in enumerate(cases) for j, y in enumerate(ys)], "k long, j long, y double")
    got = {(g.k, g.i, g.j) for g in m.greedy_match(l, r, ["k"], "x", "y", "i", "j", 5.0, small_rows=small).collect()}
    want = {(k, i, j) for k, (xs, ys) in enumerate(cases) for i, j in naive(list(enumerate(xs)), list(enumerate(ys)), 5)}
    bad = sorted({k for k, _, _ in got ^ want})
    assert not bad, [(cases[k], sorted(p[1:] for p in got if p[0] == k), sorted(p[1:] for p in want if p[0] == k)) for k in bad[:2]]


def test_greedy_with_crowded_positions(spark):
    left = [(i, 10.0) for i in range(40)] + [(100 + i, 12.0) for i in range(5)]
    right = [(i, 11.0) for i in range(30)] + [(50 + i, 10.0) for i in range(3)]
    assert run(spark, left, right, 2) == naive(left, right, 2)


def test_greedy_random(spark):
    rng = np.random.default_rng(3)
    left = list(enumerate(rng.uniform(0, 400, 150)))
    right = list(enumerate(rng.uniform(0, 400, 120)))
    assert run(spark, left, right, 6.0) == naive(left, right, 6.0)


REGISTRY = [("LINE000_defect_00", "defect", 100.0), ("LINE000_defect_01", "defect", 500.0), ("LINE000_interference_00", "interference", 800.0)]


@pytest.mark.parametrize("dug, want", [
    ([101.0, 800.5, 950.0], {101.0: ("defect", 1.0), 800.5: ("interference", 0.5), 950.0: (None, float("inf"))}),
    ([100.5, 101.5], {100.5: ("defect", 0.5), 101.5: (None, float("inf"))}),
])
def test_matching_dug_peaks(spark, dug, want):
    l = spark.createDataFrame([("LINE000", i, c) for i, c in enumerate(dug)], "line_id string, i long, x double")
    r = spark.createDataFrame([("LINE000", *s) for s in REGISTRY], "line_id string, source_id string, kind string, y double")
    got = m.match_all(l, r, ["line_id"], "x", "y", "i", "source_id", 5.0, ["kind"]).collect()
    assert {g.x: (g.kind, g.distance_m) for g in got} == want


def test_nearest_ties_and_empty(spark):
    l = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0), ("b", 3, 1.0)], "k string, i long, x double")
    r = spark.createDataFrame([("a", 10, 4.0, "p"), ("a", 11, 6.0, "q"), ("a", 9, 6.0, "r")], "k string, j long, y double, kind string")
    got = {g.i: (g.j, g.kind, g.distance_m) for g in m.nearest(l, r, ["k"], "x", "y", "j", ["kind"]).collect()}
    assert got == {1: (10, "p", 1.0), 2: (9, "r", 3.0), 3: (None, None, float("inf"))}


@pytest.mark.parametrize("crowded", [20_000, 40, 5])
def test_band_pairs_equal_brute_force(spark, crowded):
    rng = np.random.default_rng(5)
    xs, ys = rng.uniform(-20, 20, 60), rng.uniform(-20, 20, 50)
    l = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(xs)], "k string, i long, x double")
    r = spark.createDataFrame([("a", j, float(y)) for j, y in enumerate(ys)], "k string, j long, y double")
    got = {(g.i, g.j) for g in m.band_pairs(l, r, ["k"], "x", "y", 1.5, crowded).collect()}
    assert got == {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if abs(x - y) <= 1.5}


def test_interval_rows(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(20)], "k string, x double")
    iv = spark.createDataFrame([("a", 1, 2.0, 9.5), ("a", 2, 9.0, 9.0)], "k string, j long, lo double, hi double")
    got = sorted((g.j, g.x) for g in m.interval_rows(rows, iv, ["k"], "x", "lo", "hi", 4.0).collect())
    assert got == [(1, float(x)) for x in range(2, 10)] + [(2, 9.0)]


@pytest.mark.parametrize("order", ["up", "down", "mixed", "holes"])
def test_a_lattice_takes_few_rounds(spark, monkeypatch, order):
    """Evenly spaced rows: every distance is a tie."""
    rng = np.random.default_rng(6)
    n = 400
    ids = {"up": np.arange(n), "down": np.arange(n)[::-1], "mixed": rng.permutation(n), "holes": rng.permutation(n)}[order]
    at = np.arange(2 * n) * 1.0
    keep = rng.random(2 * n) < (0.9 if order == "holes" else 1.1)
    l = [(f"{i:05d}", x) for i, x, k in zip(ids.tolist(), at[::2].tolist(), keep[::2].tolist()) if k]
    r = [(f"{i:05d}", x) for i, x, k in zip(rng.permutation(n).tolist(), at[1::2].tolist(), keep[1::2].tolist()) if k]
    rounds = []
    own = m._arenas
    monkeypatch.setattr(m, "_arenas", lambda *a: rounds.append(1) or own(*a))
    left = spark.createDataFrame([("k", *x) for x in l], "k string, lid string, lx double")
    right = spark.createDataFrame([("k", *x) for x in r], "k string, rid string, rx double")
    got = m.greedy_match(left, right, ["k"], "lx", "rx", "lid", "rid", 3.0, small_rows=0)
    pairs = sorted((abs(a - b), i, j) for i, a in l for j, b in r if abs(a - b) <= 3.0)
    want, used_l, used_r = [], set(), set()
    for d, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i), used_r.add(j), want.append((i, j, d))
    assert sorted((x["lid"], x["rid"], x["distance_m"]) for x in got.collect()) == sorted(want)
    assert len(rounds) <= 20

"""Isotonic blocks and curves against the max-min form, split and unsplit."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators import isotonic
from tracewright.operators.guards import GuardError


def max_min(x, y):
    """Value at every distinct x: the largest over starts of the smallest mean over ends."""
    at = np.unique(x)
    s, w = (np.array([f(y[x == a]) for a in at], float) for f in (np.sum, len))
    cs, cw = np.r_[0, s.cumsum()], np.r_[0, w.cumsum()]
    return at, np.array([max(min((cs[k + 1] - cs[j]) / (cw[k + 1] - cw[j]) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))])


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(-4, 4)), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_pool_is_the_max_min_form(pairs):
    x, y = (np.array(c, float) for c in zip(*pairs))
    at, want = max_min(x, y)
    blocks = isotonic.pool(at, np.array([y[x == a].sum() for a in at]), np.array([(x == a).sum() for a in at], float))
    got = [next(t / n for lo, hi, t, n in blocks if lo <= a <= hi) for a in at]
    assert np.allclose(got, want)


def shapes():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 80, 400).astype(float)
    return {
        "noisy": (x, (rng.random(400) < x / 80).astype(float)),
        "falling": (x, -x),
        "rising": (x, x * 3 - 100),
        "level": (x, np.ones(400)),
        "last value far below": (np.arange(100.0), np.r_[np.arange(99.0), -5000.0]),
        "one value": (np.zeros(5), np.arange(5.0)),
    }


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("task_rows, task_knots", [(100_000, 100_000), (7, 0)])
def test_fit_and_curve(spark, name, task_rows, task_knots):
    x, y = shapes()[name]
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())) + [(None, 1.0), (3.0, None), (float("nan"), 1.0)], "a double, b double").repartition(3)
    model = isotonic.fit(rows, "a", "b", task_rows)
    model = isotonic.Isotonic(model.blocks, task_knots)
    at, want = max_min(x, y)
    probe = np.unique(np.r_[at, at + 0.25, at[0] - 10, at[-1] + 10])
    ask = spark.createDataFrame([(i, float(a)) for i, a in enumerate(probe)] + [(-1, None), (-2, float("nan")), (-3, float(at[0])), (-3, float(at[0]))], "id long, a double").repartition(2)
    got = model.apply(ask, "a", "p").collect()
    assert len(got) == len(probe) + 4
    by = {r["id"]: r["p"] for r in got}
    assert by[-1] is None and by[-2] is None and by[-3] == pytest.approx(want[0])
    assert np.allclose([by[i] for i in range(len(probe))], np.interp(probe, at, want))
    blocks = sorted(map(tuple, model.blocks.collect()))
    assert sum(b[3] for b in blocks) == len(x)
    assert all(a[1] < b[0] and a[2] <= b[2] + 1e-9 for a, b in zip(blocks, blocks[1:]))


def test_nothing_to_fit_is_an_error(spark):
    with pytest.raises(GuardError):
        isotonic.fit(spark.createDataFrame([(None, 1.0)], "a double, b double"), "a", "b")

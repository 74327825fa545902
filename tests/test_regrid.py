import random

import numpy as np

from epochloom.operators import regrid
from epochloom.operators.regrid import regular_grid, smooth


def dense(t, y, seen):
    """The same model by dense Gaussian conditioning on (level, slope) at the first time."""
    n = len(t)
    a = np.zeros((n, 2, 2 * n))
    # State as a linear map of the start and the increments, with their joint covariance.
    cov = np.zeros((2 * n, 2 * n))
    cov[:2, :2] = np.diag([1e4, 1e-4])
    now = np.zeros((2, 2 * n))
    now[:, :2] = np.eye(2)
    a[0] = now
    for k in range(1, n):
        h = t[k] - t[k - 1]
        now = np.array([[1, h], [0, 1]]) @ now
        now[:, 2 * k : 2 * k + 2] = np.eye(2)
        a[k] = now
        cov[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = [[regrid.LEVEL_DRIFT * h + regrid.SLOPE_DRIFT * h**3 / 3, regrid.SLOPE_DRIFT * h * h / 2], [regrid.SLOPE_DRIFT * h * h / 2, regrid.SLOPE_DRIFT * h]]
    level = a[:, 0]
    k = level @ cov @ level.T
    s = np.flatnonzero(seen)
    inv = np.linalg.inv(k[np.ix_(s, s)] + np.eye(len(s)))
    return k[:, s] @ inv @ y[s], np.diag(k - k[:, s] @ inv @ k[s])


def test_smoother_equals_dense_conditioning():
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 300, 40))
    t[5] = t[4]  # two readings at one time
    y, seen = rng.normal(0, 1, 40) + t / 100, rng.random(40) < 0.6
    level, var = smooth(np.stack([t, t]), np.stack([y, y]), np.stack([seen, seen]))
    want, spread = dense(t, y, seen)
    assert np.allclose(level[1], want, atol=1e-4)
    assert np.allclose(var[0], spread, rtol=1e-3, atol=1e-4)


def grid(spark, readings, runs, **more):
    r = spark.createDataFrame(readings, "key string, time double, value double")
    s = spark.createDataFrame(runs, "key string, start double, end double")
    return regular_grid(r, s, **more)


def test_cells(spark):
    nan = float("nan")
    readings = [("a", 3.0, 1.0), ("a", 3.0, 1.0), ("a", 95.0, 2.0), ("a", 41.0, None), ("a", 42.0, nan), ("a", None, 1.0), ("a", nan, 1.0), ("a", float("inf"), 2.0), (None, 5.0, 1.0), ("b", 20.0, 5.0), ("neg", -5.0, 1.0), ("neg", 10.0, 1.0)]
    runs = [("a", 0.0, 20.0), ("a", 55.0, 58.0), ("a", 80.0, None), ("a", 70.0, 60.0), ("zz", 0.0, 5.0), ("a", 0.0, 20.0)]
    out = grid(spark, readings, runs, span_cells=4).collect()
    got = {(r["key"], r["cell"]): r["kind"] for r in out}
    assert len(out) == len(got)
    assert {c: k for (key, c), k in got.items() if key == "a"} == {0: "observed", 1: "lost", 2: "lost", 3: "break", 4: "break", 5: "lost", 6: "break", 7: "break", 8: "break", 9: "observed"}
    assert {c: k for (key, c), k in got.items() if key == "b"} == {2: "observed"}
    assert {c: k for (key, c), k in got.items() if key == "neg"} == {-1: "observed", 0: "break", 1: "observed"}
    assert next(r["readings"] for r in out if (r["key"], r["cell"]) == ("a", 0)) == 1
    assert all(r["sd"] > 0 and r["value"] == r["value"] for r in out)


def test_spans_agree_with_one_piece_and_uncertainty_grows(spark):
    rng = random.Random(2)
    readings = [("a", t, 10 + t / 100 + rng.gauss(0, 0.1)) for t in (rng.uniform(0, 4000) for _ in range(700)) if not 1500 < t < 1700]
    runs = [("a", 0.0, 4000.0)]
    one = {r["cell"]: r for r in grid(spark, readings, runs, span_cells=10_000).collect()}
    many = {r["cell"]: r for r in grid(spark, readings, runs, span_cells=60).collect()}
    assert one.keys() == many.keys()
    assert all(one[c]["kind"] == many[c]["kind"] for c in one)
    assert max(abs(one[c]["value"] - many[c]["value"]) for c in one) < 1e-3
    assert abs(one[100]["value"] - 20) < 1
    assert one[160]["sd"] > 3 * one[100]["sd"] and one[160]["kind"] == "lost"


def test_empty(spark):
    assert grid(spark, [], []).count() == 0


def test_gaps_longer_than_spans_equal_one_piece(spark):
    """Gaps over several spans, over an edge, and a source far from zero in tiny units."""
    rng = random.Random(5)
    readings = [("a", t, 5e-6 * (40 + t / 500 + rng.gauss(0, 1))) for t in (rng.uniform(1234, 30_000) for _ in range(1500)) if not 4000 < t < 14_000 and not 17_600 < t < 18_300]
    readings += [("b", t, 1e6 + rng.gauss(0, 1)) for t in (5.0, 7.0, 20.0, 9000.0)]
    one = {(r["key"], r["cell"]): r for r in grid(spark, readings, [], span_cells=10_000).collect()}
    for cells in (20, 360):
        many = {(r["key"], r["cell"]): r for r in grid(spark, readings, [], span_cells=cells).collect()}
        assert one.keys() == many.keys()
        for key, unit in (("a", 5e-6), ("b", 1.0)):
            mine = [c for c in one if c[0] == key]
            ratio = many[mine[0]]["sd"] / one[mine[0]]["sd"]
            assert key == "b" or 0.5 < ratio < 2
            assert max(abs(one[c]["value"] - many[c]["value"]) for c in mine) < 1e-2 * unit
            assert max(abs(many[c]["sd"] / one[c]["sd"] / ratio - 1) for c in mine) < 1e-3
    middle = one[("a", 900)]
    assert 4e-5 < middle["value"] < 1e-3 and middle["sd"] > 10 * one[("a", 300)]["sd"]


def test_infinite_readings_stay_out(spark):
    out = {r["cell"]: r for r in grid(spark, [("a", 5.0, 1.0), ("a", 15.0, float("inf")), ("a", 25.0, 1.2), ("a", 35.0, 1.1), ("b", 5.0, float("inf"))], []).where("key = 'a'").collect()}
    assert out[1]["kind"] == "observed" and all(0.9 < r["value"] < 1.3 for r in out.values())


def test_long_gap_is_passed_over_in_closed_form(spark):
    readings = [("a", 1.0, 1.0), ("a", 2.0, 1.1), ("a", 400_000.0, 3.0), ("a", 400_010.0, 3.1)]
    runs = [("a", 0.0, 1e12), ("a", -1e12, 5.0)]
    one, many = ({r["cell"]: r for r in grid(spark, readings, runs, span_cells=cells).collect()} for cells in (100_000, 3))
    assert one.keys() == many.keys() and len(one) == 40_002
    assert {r["kind"] for r in many.values()} == {"observed", "lost"}
    for c in (0, 1, 500, 20_000, 39_999, 40_000):
        assert abs(one[c]["value"] - many[c]["value"]) < 1e-5 and abs(many[c]["sd"] * one[0]["sd"] / many[0]["sd"] / one[c]["sd"] - 1) < 1e-3

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.llm import sketch as s

SMALL = s.Shape(bits=14, width=256, depth=5)
QS = [0.05, 0.5, 0.95]


def frame(spark, n=6000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice(["x", "y"]), rng.betavariate(2, 5)) for _ in range(n)] + [("a", "x", None), ("a", "x", float("nan")), (None, None, 0.5), ("c", "x", None)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "g string, h string, v double, key string")


def exact(rows):
    groups = {}
    for g, h, v in rows:
        if v is not None and v == v:
            groups.setdefault((g, h), []).append(v)
    return {k: sorted(v) for k, v in groups.items()}


def test_rank_error_is_bounded(spark):
    rows, df = frame(spark)
    want = exact(rows)
    out = s.percentiles(s.build_sketches(df, "v", ["g", "h"], SMALL), ["g", "h"], SMALL, QS).collect()
    assert {(r["g"], r["h"]) for r in out} == set(want)
    for r in out:
        v = np.array(want[(r["g"], r["h"])])
        assert r["n_values"] == len(v)
        low, high = np.searchsorted(v, r["value"] - 2**-13), np.searchsorted(v, r["value"] + 2**-13, "right")
        rank = max(1, np.ceil(r["q"] * len(v)))
        assert low - r["rank_error"] * len(v) - 1 <= rank <= high + r["rank_error"] * len(v) + 1


def test_exact_percentiles(spark):
    rows, df = frame(spark, 3000)
    want = exact(rows)
    for r in s.exact_percentiles(df, "v", ["g", "h"], SMALL, QS).collect():
        v = want[(r["g"], r["h"])]
        assert r["exact"] == v[max(1, int(np.ceil(r["q"] * len(v)))) - 1]


def test_exact_percentiles_outside_the_range(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(-50, 51)] + [("a", float("inf"))], "g string, v double")
    assert [r["exact"] for r in s.exact_percentiles(df, "v", ["g"], SMALL, QS).orderBy("q").collect()] == [-45.0, 0.0, 46.0]


def flat(sketches):
    parts = {}
    for r in sketches.collect():
        parts.setdefault(r["key"], {})[r["part"]] = r["cells"]
    return {k: [c for p in sorted(v) for c in v[p]] for k, v in parts.items()}


def test_merging_and_deleting(spark):
    _, df = frame(spark, 2000)
    whole = flat(s.build_sketches(df, "v", ["g", "h"], SMALL))
    days = s.build_sketches(df.withColumn("day", (F.col("v") * 10).cast("int")), "v", ["g", "h", "day"], SMALL)
    assert flat(s.merge_sketches(days, s.drop_group(2, 2))) == whole
    first, rest = df.where("v < 0.3"), df.where("v >= 0.3")
    assert {k: v for k, v in flat(s.subtract_sketches(s.build_sketches(df, "v", ["g", "h"], SMALL), s.build_sketches(rest, "v", ["g", "h"], SMALL))).items() if any(v)} == flat(s.build_sketches(first, "v", ["g", "h"], SMALL))
    both = df.withColumn("w", F.lit(1)).unionByName(rest.withColumn("w", F.lit(-1)))
    assert {k: v for k, v in flat(s.build_sketches(both, "v", ["g", "h"], SMALL, F.col("w"))).items() if any(v)} == flat(s.build_sketches(first, "v", ["g", "h"], SMALL))


def test_empty(spark):
    _, df = frame(spark, 10)
    assert s.percentiles(s.build_sketches(df.limit(0), "v", ["g"], SMALL), ["g"], SMALL, QS).count() == 0


def test_estimates_are_unbiased_enough():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 2**14, 5000)
    sk = s.sketch_values(SMALL, SMALL.decode(code), np.zeros(5000, int), np.ones(5000), 1)[0]
    got = [s.estimate(SMALL, sk, 14, n) for n in range(0, 2**14, 97)]
    true = np.bincount(code, minlength=2**14)[::97]
    assert abs(np.mean(np.array(got) - true)) < 1.0
    assert s.invert(SMALL, np.zeros_like(sk), QS)[0] == 0
    assert s.invert(SMALL, sk, [0.5])[1][0] == pytest.approx(np.median(SMALL.decode(code)), abs=0.05)


def test_values_outside_the_range_keep_their_ranks(spark):
    df = spark.createDataFrame([("a", float(i) / 10) for i in range(-5, 16)] + [("b", 7.0), ("b", float("-inf"))], "g string, v double")
    sketches = s.build_sketches(df, "v", ["g"], SMALL)
    out = {(r["g"], r["q"]): (r["n_values"], r["n_outside"], r["value"]) for r in s.percentiles(sketches, ["g"], SMALL, QS).collect()}
    assert out["a", 0.05] == (21, 10, float("-inf")) and out["a", 0.95] == (21, 10, float("inf")) and abs(out["a", 0.5][2] - 0.5) < 0.01
    assert out["b", 0.05] == (2, 2, float("-inf")) and out["b", 0.95] == (2, 2, float("inf"))
    assert s.within_bounds(df, "v", ["g"], s.percentiles(sketches, ["g"], SMALL, QS), SMALL).where("within").count() == 6


def test_bounds_are_checked_against_the_rows(spark):
    _, df = frame(spark, 4000)
    found = s.percentiles(s.build_sketches(df, "v", ["g", "h"], SMALL), ["g", "h"], SMALL, QS)
    assert s.within_bounds(df, "v", ["g", "h"], found, SMALL).where("NOT within").count() == 0
    wrong = found.withColumn("value", F.col("value") + 0.3)
    assert s.within_bounds(df, "v", ["g", "h"], wrong, SMALL).where("within").count() < found.count()

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.operators import spikes
from epochloom.operators.select import select_ranks
from epochloom.operators.spikes import flag_readings

INF = float("inf")


def brute(rows):
    """Ids by the exact rules."""
    found, sources = set(), {}
    for rid, src, t, y in rows:
        if y is not None and y == y:
            sources.setdefault(src, {}).setdefault((t, y), []).append(rid)
    for readings in sources.values():
        order = sorted(readings)
        fine = [y for _, y in order if 0 < y < INF]
        m = median(fine) if fine else None
        mad = median(abs(y - m) for y in fine) if fine else None
        k = 0
        while k < len(order):
            j = k
            while j < len(order) and order[j][1] == order[k][1]:
                j += 1
            for o in order[k:j]:
                y = o[1]
                if not 0 < y < INF or j - k >= 5 or (len(fine) >= 20 and abs(y - m) > 12 * mad):
                    found |= set(readings[o])
            k = j
    return found


def data(seed, n=1500):
    rng = random.Random(seed)
    rows, level = [], {}
    for i in range(n):
        src = rng.choice(["hot"] * 4 + ["a", "b", "tiny", None])
        base = level.setdefault(src, rng.uniform(1, 100))
        y = base * (1 + 0.05 * rng.gauss(0, 1))
        r = rng.random()
        y = y * 40 if r < 0.02 else None if r < 0.04 else float("nan") if r < 0.05 else -1.0 if r < 0.06 else INF if r < 0.065 else y
        rows.append((i, src, float(rng.randint(0, 3000)), y))
    for start in (100.0, 900.0, 995.0, 1700.0):  # stuck stretches, some over a chunk's edge
        for k in range(rng.choice([4, 5, 9])):
            rows.append((n + len(rows), "hot", start + k / 100, 7.25))
    rows += [(10**6 + i, *r[1:]) for i, r in enumerate(rows[:80])]  # delivered twice
    return rows


def flags(spark, rows, width=100.0, **more):
    df = spark.createDataFrame(rows, "id long, src string, t double, y double").withColumns({"_k0": F.lit(1), "row_id": F.lit("clash")})
    return flag_readings(df, "id", ["src"], [F.col("t")], "y", (F.col("y") > 0) & (F.col("y") < INF), [F.floor(F.col("t") / width)], **more)


def found(spark, rows, width=100.0, **more):
    got = [r["row_id"] for r in flags(spark, rows, width, **more).where("impossible OR stuck OR spike").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = data(seed)
    assert found(spark, rows) == brute(rows)


def test_chunks_of_any_size_give_the_same_flags(spark):
    """Not only the cases: every row with a large innovation, and the innovation."""
    rows = data(3)
    one = {r["row_id"]: r for r in flags(spark, rows).collect()}
    assert {i for i, r in one.items() if r["impossible"] or r["stuck"] or r["spike"]} == brute(rows)
    many = {r["row_id"]: r for r in flags(spark, rows, 437.0, whole_rows=100).collect()}
    assert many.keys() == one.keys()
    for i, r in one.items():
        assert (r["impossible"], r["stuck"], r["spike"]) == (many[i]["impossible"], many[i]["stuck"], many[i]["spike"])
        assert (r["innovation"] is None) == (many[i]["innovation"] is None) and abs((r["innovation"] or 0) - (many[i]["innovation"] or 0)) < 1e-6 * max(1, abs(r["innovation"] or 0))


def test_the_filter_chooses_what_is_measured(monkeypatch):
    """Without flagged innovations no median distance is computed, and nothing is a spike."""
    y, source = np.array([1.0, 1.1, 0.9, 1.0] * 6 + [50.0] + [2.0, 2.2, 1.8, 2.0] * 6), np.array([0] * 25 + [1] * 24)
    med, near, size = spikes._middle(y, source, 2)
    assert np.all(near <= [np.median(np.abs(y[source == k] - med[k])) for k in (0, 1)])
    measured = []
    middle = spikes._middle
    monkeypatch.setattr(spikes, "_middle", lambda v, g, n: measured.append(len(v)) or middle(v, g, n))
    nu = np.where(y == 50.0, 9.0, 0.1)
    assert spikes._spikes(y, source, nu, med, size, {"mads": 12.0, "least": 20}).nonzero()[0].tolist() == [24] and measured == [25]
    assert not spikes._spikes(y, source, np.zeros(len(y)), med, size, {"mads": 12.0, "least": 20}).any() and measured == [25]


def test_constant_source_and_ties(spark):
    rows = [(i, "a", float(i), 2.0) for i in range(30)] + [(99, "a", 40.0, 2.5), (100, "b", 1.0, 3.0), (101, "b", 1.0, 3.0)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", 0.0, None), (2, None, None, None)]) == set()


def test_select_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), rng.choice([0.0, -0.0, -1e300, 5e-324, rng.gauss(0, 1), 3.5, -INF])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = [(g, k, r) for g in ("x", "y", None) for k, r in enumerate((1, 50, 120))]
    got = {(r["g"], r["target"]): r["value"] for r in select_ranks(df, ["g"], "v", spark.createDataFrame(wanted, "g string, target int, rank long")).collect()}
    for g, k, r in wanted:
        assert got[(g, k)] == sorted(v for h, v in rows if h == g)[r - 1]


def test_stuck_runs_far_from_the_median_of_small_sources(spark):
    """Below 20 possible readings only the stuck rule applies; MAD 0, or tiny against the distance of the run."""
    rows = [(i, "flat", float(i), 0.01) for i in range(8)] + [(20 + i, "flat", 20.0 + i, 0.9) for i in range(5)]
    rows += [(40 + i, "tight", float(i), 0.01 + 1e-6 * (i % 5)) for i in range(12)] + [(60 + i, "tight", 20.0 + i, 0.9) for i in range(5)]
    assert {*range(20, 25), *range(60, 65)} <= found(spark, rows)
    assert found(spark, rows) == brute(rows)

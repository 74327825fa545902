import random

from epochloom.llm.nearest import match_nearest


def brute(left, right, tolerance):
    out = {}
    for i, k, t in left:
        near = sorted((abs(m - t), m, p) for j, m, p in right if k is not None and j == k and t is not None and m is not None and abs(m - t) <= tolerance)
        if near:
            out[i] = near[0][2]
    return out


def run(spark, left, right, tolerance):
    a = spark.createDataFrame([(*x, "c", 1) for x in left], "id long, k string, t long, p string, _bin int")
    b = spark.createDataFrame([(*x, "c") for x in right], "k string, t long, p long, id string")
    got = match_nearest(a, b, ["k"], "id", "t", "p", tolerance).collect()
    assert len(got) == len({r["id"] for r in got})
    return {r["id"]: r["p"] for r in got}


def test_matches_brute_force(spark):
    rng = random.Random(11)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    right = [(key(), rng.choice([rng.randint(-200, 3000), None]) if rng.random() < 0.1 else rng.randint(-200, 3000), rng.randint(0, 5)) for _ in range(250)]
    left = [(i, key(), rng.randint(-300, 3200) if rng.random() < 0.95 else None) for i in range(400)]
    for tolerance in (0, 1, 7, 45):
        assert run(spark, left, right, tolerance) == brute(left, right, tolerance)


def test_ties_go_to_the_earlier_and_bounds_are_inclusive(spark):
    right = [("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 200, 4)]
    left = [(1, "a", 5), (2, "a", 6), (3, "a", 245), (4, "a", 246), (5, "a", -45), (6, "a", -46)]
    assert run(spark, left, right, 45) == {1: 1, 2: 2, 3: 4, 5: 1}


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1)], 5) == {}
    assert run(spark, [(1, "a", 1)], [], 5) == {}

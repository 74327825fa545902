import random

from hypothesis import given
from hypothesis import strategies as st

from epochloom.operators.intervals import IntervalMap, merge_intervals, starts_inside

pairs = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)).map(lambda x: (x[0], x[0] + x[1])), max_size=25)


def brute(intervals, tolerance):
    periods = []
    for s, e in sorted(intervals):
        if periods and s <= periods[-1][1] + tolerance:
            periods[-1][1] = max(periods[-1][1], e)
        else:
            periods.append([s, e])
    return [tuple(p) for p in periods]


@given(pairs, st.sampled_from([0, 1.5, 3]))
def test_map_is_order_free(intervals, tolerance):
    shuffled = list(intervals)
    random.Random(1).shuffle(shuffled)
    m = IntervalMap(tolerance)
    for s, e in shuffled:
        m.insert(s, e)
    wanted = brute(intervals, tolerance)
    assert list(zip(m.starts, m.ends, strict=True)) == wanted
    assert m.gaps == [None, *(b[0] - a[1] for a, b in zip(wanted, wanted[1:], strict=False))][: len(wanted)]


def expected(rows, tolerance):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        good = [(s, e) for k, s, e, *_ in rows if k == key and s is not None and e is not None and e >= s]
        p = brute(good, tolerance.get(key, 0))
        out |= {(key, "period", s, e) for s, e in p} | {(key, "gap", a[1], b[0]) for a, b in zip(p, p[1:], strict=False)}
    return out


def test_merge_matches_brute_force_across_buckets(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        key = rng.choice(["hot", "hot", "b", "c", None])
        s = rng.randint(-500, 5000)
        rows.append((key, s, rng.choice([s, s + rng.randint(0, 40), s + 700 if rng.random() < 0.02 else s + 3, s - 5, None]), 1, "x"))
    rows += rows[:50]  # delivered twice
    df = spark.createDataFrame(rows, "key string, start_ms long, end_ms long, bucket int, kind string")
    tolerance = {"hot": 1.5, "b": 3.0}
    tol = spark.createDataFrame(list(tolerance.items()), "id string, tolerance double")
    got = merge_intervals(df, "key", "start_ms", "end_ms", tol, bucket_ms=100).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == expected(rows, tolerance)


def test_empty_and_single_point(spark):
    empty = spark.createDataFrame([], "key string, s long, e long")
    assert merge_intervals(empty, "key", "s", "e").count() == 0
    point = spark.createDataFrame([("a", 5, 5), ("a", None, 9), ("a", 9, None), (None, 1, 2)], "key string, s long, e long")
    assert [tuple(r) for r in merge_intervals(point, "key", "s", "e").collect()] == [("a", "period", 5, 5)]


def test_starts_inside(spark):
    periods = spark.createDataFrame([("a", 0, 1000), ("a", 2000, 2500), ("b", 0, 10)], "key string, start_ms long, end_ms long")
    tol = spark.createDataFrame([("a", 3.0)], "id string, tolerance double")
    points = [("a", 3, 9), ("a", 4, 9), ("a", 4, 9), ("a", 1000, 1100), ("a", 1001, 1100), ("a", 2400, None), ("b", 1, 2), (None, 5, 6), ("a", None, 6)]
    got = starts_inside(spark.createDataFrame(points, "key string, start_ms long, end_ms long"), periods, tol, bin_ms=100).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1000, 1100), ("a", 2400, None), ("a", 4, 9), ("b", 1, 2)]


def test_stream_state_equals_batch(spark, tmp_path):
    from epochloom.streaming.periods import latest, run_to_table, stream_pieces

    rng = random.Random(3)
    rows = [(rng.choice("ab"), s := rng.randint(0, 3000), s + rng.randint(0, 30)) for _ in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "key string, start_ms long, end_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, start_ms long, end_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_table(stream_pieces(stream, 0.0, 500), str(tmp_path / "out"), str(tmp_path / "ck"))
    pieces = latest(spark.read.parquet(str(tmp_path / "out")))
    got = {tuple(r) for r in merge_intervals(pieces, "key", "start_ms", "end_ms", bucket_ms=500).collect()}
    assert got == expected(rows, {})


def test_absurd_ends_cost_one_row(spark):
    far = 10**15
    periods = spark.createDataFrame([("a", "period", 0, 100), ("a", "period", 200, far), ("b", "period", -far, -5)], "key string, kind string, start_ms long, end_ms long")
    tolerance = spark.createDataFrame([("a", 10.0)], "recording_id string, tolerance double")
    points = spark.createDataFrame([("a", 5, 6), ("a", 50, 60), ("a", 150, 160), ("a", 205, 206), ("a", 10**14, None), ("a", far + 1, None), ("b", -6, 0), ("b", -4, 0), ("c", 1, 2), (None, 1, 2), ("a", None, 2), ("a", 50, 60)], "key string, start_ms long, end_ms long")
    got = sorted((r["key"], r["start_ms"]) for r in starts_inside(points, periods, tolerance).collect())
    assert got == [("a", 50), ("a", 10**14), ("b", -6)]

import os

import pytest

from epochloom.llm.bpe import VOCABULARY
from epochloom.llm.mixing import Share, default_total, mix_sources, repetitions, water_fill


def test_water_filling():
    shares = [Share("big", 0.5, 1000, 1), Share("mid", 0.3, 100, 2), Share("tiny", 0.2, 10, 4), Share("none", 0.1, 0, 4)]
    given = water_fill(shares, 800)
    assert given["none"] == 0 and given["tiny"] == 40 and given["mid"] == 200 and given["big"] == 560
    assert sum(given.values()) == pytest.approx(800)
    small = water_fill(shares[:2], 160)
    assert small == {"big": pytest.approx(100), "mid": pytest.approx(60)}
    assert sum(water_fill(shares, 10**6).values()) == 1240
    assert water_fill([], 5) == {} and water_fill([Share("a", 0.0, 5, 1)], 5) == {"a": 0.0}


def test_default_total():
    shares = [Share("a", 0.8, 1000, 1), Share("b", 0.2, 10, 2), Share("none", 0.1, 0, 9)]
    total = default_total(shares, 0.05)
    assert 0.2 - 20 / total == pytest.approx(0.05, abs=1e-6)
    assert default_total([], 0.05) == 0.0 and default_total([Share("a", 1.0, 10, 3)], 0.05) == 30


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_mix(spark):
    docs = [(i, ["a", "b", "c", None, "other"][i % 5], "word " * (1 + i % 7) if i % 11 else ["", None][i % 2], "x") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, bucket string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.2, 1), ("c", 0.05, 1), ("empty", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(df, targets, total_tokens=4000)
    rows, shares = chosen.collect(), {r["source"]: r for r in report.collect()}
    assert len(rows) == len({r["doc_id"] for r in rows}) and {r["source"] for r in rows} <= {"a", "b", "c"}
    assert all(1 <= r["repeats"] <= {"a": 3, "b": 1, "c": 1}[r["source"]] for r in rows)
    for source, weight in (("a", 0.7), ("b", 0.2), ("c", 0.05)):
        tokens = sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == source)
        assert tokens == shares[source]["actual_tokens"] == pytest.approx(4000 * weight / 0.95, rel=0.02)
    assert shares["empty"]["actual_tokens"] == 0 and sum(s["actual_share"] for s in shares.values()) == pytest.approx(1)
    again = {(r["doc_id"], r["repeats"]) for r in mix_sources(df.repartition(7), targets, total_tokens=4000)[0].collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in rows}
    assert mix_sources(df.limit(0), targets)[0].count() == 0
    assert mix_sources(df, targets.limit(0))[0].count() == 0


def test_a_rounding_error_below_k_times_is_k_times():
    assert repetitions(234_341.99999999997, 117_171) == (2, 0.0)
    whole, missing = repetitions(300_000.0, 117_171)
    assert whole == 2 and missing == 300_000 - 2 * 117_171
    assert repetitions(5.0, 0) == (0, 0.0) and repetitions(0.0, 10) == (0, 0.0) and repetitions(3.0, 10) == (0, 3.0)

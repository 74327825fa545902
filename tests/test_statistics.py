import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.functions import probability as pr
from epochloom.operators import changes, checks, joins, mixed, ranks, selection, windows

P = list(pr.PROBABILITIES)


@pytest.fixture(scope="module")
def planted(spark):
    """12 subjects x 2 electrodes x 2 conditions x 2 labels x 3 epochs with known changes."""
    rng = random.Random(4)
    rows = []
    for s, e, cond, label, epoch in itertools.product(range(12), range(2), ("placebo", "DMT"), ("before", "after"), range(3)):
        w = 0.2 + 0.002 * s + 0.003 * e
        if label == "after":
            w += 0.04 + 0.001 * s + 0.001 * e if cond == "placebo" else 0.14 + 0.002 * s - 0.001 * e
        w += rng.gauss(0, 1e-4)
        rest = (1 - w) / 4
        rows.append((f"S{s}", cond, f"E{e}", "gssc", label, epoch, w, rest, rest, rest, rest))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "subject string, condition string, electrode string, stager string, experimental_label string, epoch int, " + ", ".join(f"{p} double" for p in P)).cache()


ENTITY = ["subject", "condition", "electrode", "stager"]
ONE = {"before_to_after": ("before", "after")}


def test_changes_and_effects(planted):
    wide = changes.within_changes(planted, ["prob_w"], ENTITY, contrasts=ONE)
    assert wide.count() == 48
    mean = wide.where("condition = 'placebo'").agg(F.avg("prob_w__delta_abs")).first()[0]
    assert mean == pytest.approx(0.04 + 0.001 * 5.5 + 0.0005, abs=1e-4)
    effects = changes.treatment_effects(wide, ["prob_w"], ["subject", "electrode", "stager", "contrast"])
    assert effects.count() == 48
    assert effects.where("delta_type = 'abs'").agg(F.avg("prob_w__effect")).first()[0] == pytest.approx(0.1 + 0.001 * 5.5 - 0.001, abs=1e-4)
    assert changes.cohen_d(planted, ["prob_w"], ENTITY, contrasts=ONE).where("prob_w__cohen_d > 0").count() == 48


def test_changes_with_missing(spark):
    nan = float("nan")
    rows = [("a", "before", 0.0), ("a", "after", 0.5), ("b", "before", None), ("b", "after", 0.2), ("c", "before", 1.0), (None, "before", -0.5), (None, "after", nan), (None, "after", 0.5)]
    df = spark.createDataFrame(rows, "e string, l string, v double")
    got = {r["e"]: r for r in changes.within_changes(df, ["v"], ["e"], "l", ONE, ("abs", "rel", "logit")).collect()}
    assert set(got) == {"a", "b", None}
    assert got["a"]["v__delta_abs"] == 0.5 and got["a"]["v__delta_rel"] == pytest.approx(0.5 / 1e-6)
    assert got["b"]["v__delta_abs"] is None
    assert got[None]["v__delta_rel"] == pytest.approx(-2.0) and got[None]["v__delta_logit"] is None
    assert changes.within_changes(df.limit(0), ["v"], ["e"], "l", ONE).count() == 0


def test_paired_signed_rank(planted):
    r = ranks.paired_signed_rank(planted.where("experimental_label = 'after'"), ["prob_w"], ["stager"]).first()
    assert (r["n_pairs"], r["n_nonzero_pairs"]) == (12, 12)
    assert r["median_difference"] > 0.09 and r["rank_biserial"] > 0.99
    assert r["p_value"] == pytest.approx(2 / 2**12)
    fewer = ranks.paired_signed_rank(planted.where("experimental_label = 'after' AND NOT (subject = 'S3' AND condition = 'DMT')"), ["prob_w"], ["stager"]).first()
    assert fewer["n_pairs"] == 11


def test_signed_rank_p_by_enumeration():
    n = 7
    sums = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in (0, 3, 9, 14):
        assert ranks.signed_rank_p(n, w, 0, 0) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
    assert ranks.signed_rank_p(0, 0, 0, 3) is None
    assert 0 < ranks.signed_rank_p(60, 500, 0, 0) < 0.01


def test_adjustments(spark):
    df = spark.createDataFrame([("x", 0.01), ("x", 0.04), ("x", 0.03), ("x", None), ("x", float("nan")), ("y", 0.5)], "f string, p double")
    got = sorted(((r["f"], r["p"], r["p_adjusted"]) for r in ranks.adjust_pvalues(df, "p", ["f"]).collect()), key=str)
    assert [g[2] for g in got if g[1] in (0.01, 0.03, 0.04)] == pytest.approx([0.03, 0.04, 0.04])
    assert [g[2] for g in got if g[1] is None or g[1] != g[1]] == [None, None]
    assert [r["p_adjusted"] for r in ranks.adjust_pvalues(df, "p", ["f"], "bonferroni").where("f = 'x'").orderBy("p").collect()][1:4] == pytest.approx([0.03, 0.09, 0.12])
    with pytest.raises(ValueError):
        ranks.adjust_pvalues(df, "p", ["f"], "holm")


def test_correlation_matrix(spark):
    rows = [(float(i), float(-i) if i != 3 else None, 1.0) for i in range(6)] + [(None, 1.0, 1.0), (2.0, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["right"], r["method"]): r for r in ranks.correlation_matrix(df, ["a"], ["b", "c"], [], least=3).collect()}
    assert got[("b", "pearson")]["correlation"] == pytest.approx(-1) and got[("b", "spearman")]["correlation"] == pytest.approx(-1)
    assert (got[("b", "pearson")]["n_used"], got[("b", "pearson")]["n_missing"]) == (5, 3)
    assert got[("c", "pearson")]["correlation"] is None
    assert ranks.correlation_matrix(df, ["a"], ["b"], [], least=30).where("correlation IS NOT NULL").count() == 0


def test_correlation_p():
    # Published two-sided 5 % critical values of r.
    for n, r in ((5, 0.878), (12, 0.576), (32, 0.349)):
        assert ranks.correlation_p(r, n) == pytest.approx(0.05, abs=6e-4)
    assert ranks.correlation_p(1.0, 5) == 0.0 and ranks.correlation_p(0.3, 2) is None
    assert mixed.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert mixed.chi_square_tail(20.0, 3) == pytest.approx(0.000169742, abs=1e-8)


def test_stager_agreement(spark):
    rows = [("r", "b", k, s, 0.1 * k + (0.1 if s == "b" else 0.0)) for k in range(1, 4) for s in "ab"]
    df = spark.createDataFrame(rows, "rec string, block string, epoch int, stager string, prob_w double")
    r = ranks.stager_agreement(df, ["prob_w"], ["rec", "block", "epoch"], []).first()
    assert r["correlation"] == pytest.approx(1.0) and r["n_epochs"] == 3


def dense_loglik(y, x, s, e, t1, t2):
    z1 = np.equal.outer(s, s).astype(float)
    z2 = np.equal.outer(s * 100 + e, s * 100 + e).astype(float)
    v = np.eye(len(y)) + t1 * z1 + t2 * z2
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    r = y - x @ beta
    s2 = r @ inv @ r / len(y)
    return -0.5 * (len(y) * math.log(2 * math.pi * s2) + np.linalg.slogdet(v)[1] + len(y)), beta


def test_mixed_profile_equals_dense():
    rng = np.random.default_rng(1)
    s, e = np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(3), 4), 5)
    x = np.column_stack([np.ones(60), rng.normal(size=60)])
    y = x @ [1.0, 0.5] + rng.normal(size=5)[s] + rng.normal(size=60)
    cells = sorted(set(zip(s, e, strict=True)))
    z = np.column_stack([x, y])
    pick = [np.flatnonzero((s == a) & (e == b)) for a, b in cells]
    n, sums, ss = np.array([len(i) for i in pick], float), np.stack([z[i].sum(axis=0) for i in pick]), np.stack([z[i].T @ z[i] for i in pick])
    subject = np.array([a for a, _ in cells])
    for t1, t2 in ((0.0, 0.0), (0.7, 0.2), (3.0, 0.0)):
        ll, beta, *_ = mixed._profile(t1, t2, n, sums, ss.sum(axis=0), subject, 5)
        want, b = dense_loglik(y, x, s, e, t1, t2)
        assert ll == pytest.approx(want) and np.allclose(beta, b)
    best = mixed.fit(n, sums, ss, subject, True)
    assert best["loglik"] >= max(dense_loglik(y, x, s, e, a, b)[0] for a in (0.1, 0.5, 1, 2) for b in (0, 0.1, 0.5)) - 1e-6


def test_mixed_models_on_planted(planted):
    treated, after = (F.col("condition") == "DMT").cast("double"), (F.col("experimental_label") == "after").cast("double")
    fits = mixed.fit_mixed_models(planted, ["prob_w"], {"t": treated, "a": after, "t:a": treated * after}, "subject", "electrode", ("stager",))
    r = {x["term"]: x for x in fits.collect()}
    assert r["t:a"]["estimate"] == pytest.approx(0.105, abs=0.005) and r["t:a"]["status"] == "ok" and r["t:a"]["n_used"] == 288
    few = mixed.fit_mixed_models(planted.limit(4), ["prob_w"], {"a": after}, strata=("stager",)).first()
    assert few["status"] == "too_few_observations" and (few["estimate"] is None or few["estimate"] != few["estimate"])
    same = mixed.fit_mixed_models(planted, ["prob_w"], {"a": after, "b": after}, strata=("stager",)).first()
    assert same["status"] == "fit_failed"


def test_probability_functions(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.5, 0.5, 0.0, 0.0, 0.0), (0.2,) * 5, (nan, 0.5, 0.5, 0.0, 0.0), (None,) * 5], ", ".join(f"{p} double" for p in P))
    r = df.select(pr.entropy(P).alias("h"), pr.entropy(P, True).alias("n"), pr.argmax_label(P, list(pr.STAGES)).alias("a"), pr.valid_probabilities(P).alias("v")).collect()
    assert r[0]["h"] == pytest.approx(math.log(2)) and r[1]["n"] == pytest.approx(1) and r[2]["h"] is None and r[3]["h"] is None
    assert [x["a"] for x in r] == ["w", "w", "n1", None]
    assert r[0]["v"] and r[1]["v"] and not r[2]["v"]
    other = df.select(F.col("prob_r").alias("REM"), F.lit(1).alias("k"), F.col("prob_w").alias("wake"), F.col("prob_n1").alias("S1"), F.col("prob_n2").alias("N2"), F.col("prob_n3").alias("prob_N3"))
    assert pr.probability_columns(other).columns == ["k", *P]
    with pytest.raises(ValueError):
        pr.probability_columns(df.drop("prob_r"))
    p = spark.createDataFrame([(0.0005,), (0.03,), (0.2,), (None,)], "p double").select(pr.stars(F.col("p")).alias("s")).collect()
    assert [x["s"] or "" for x in p] == ["***", "*", "", ""]
    with pytest.raises(ValueError):
        pr.check_windows({"a": (0, 10), "b": (9, 20)})
    pr.check_windows({"a": (0, 10), "b": (10, 20)})


def test_joins(spark):
    f = spark.createDataFrame([("r", "b", 0, "E1", 0.4)], "recording_id string, block_id string, epoch int, electrode string, bp_rel_alpha double")
    h = spark.createDataFrame([("r", "b", 0, "E1", "gssc", 0.1), ("r", "b", 0, None, "sleepfm", 0.2)], "recording_id string, block_id string, epoch int, electrode string, stager string, prob_w double")
    got = joins.features_with_probabilities(f, h, strict=True).collect()
    assert [(r["stager"], r["bp_rel_alpha"]) for r in got] == [("gssc", 0.4)]
    with pytest.raises(ValueError, match="without features"):
        joins.features_with_probabilities(f.limit(0), h, strict=True)
    with pytest.raises(ValueError, match="share a key"):
        joins.features_with_probabilities(f.unionByName(f), h, strict=True)
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, y int")
    assert sorted((r["x"], r["y"]) for r in checks.join_null_safe(left, right, ["k"]).collect()) == [(1, 3), (2, 4)]
    assert checks.join_null_safe(left, right.limit(0), ["k"], "left_anti").count() == 2


def test_overlap_pairs_match_brute_force(spark):
    rng = random.Random(8)
    one = [("k" if rng.random() < 0.8 else "z", i, a := rng.uniform(0, 500), a + rng.choice([0, 30, 200])) for i in range(80)]
    two = [("k" if rng.random() < 0.8 else None, i, a := rng.uniform(0, 500), a + rng.choice([0, 30, 90])) for i in range(80)] + [("k", 99, one[0][3], one[0][3] + 5)]
    # Long and absurdly long intervals, which lie in a few bins of their own level, and ends that are none.
    one += [("k", 90, 10.0, 1e12), ("k", 91, -1e12, 250.0), ("z", 92, 100.0, 5000.0), ("k", 93, 5.0, float("inf")), ("k", 94, 5.0, float("nan"))]
    two += [("k", 100, -1e11, 1e13), ("z", 101, 130.0, 1e9), ("k", 102, 3.0, None)]
    got = joins.overlap_pairs(spark.createDataFrame(one, "k string, i int, l_start double, l_end double"), spark.createDataFrame(two, "k string, j int, r_start double, r_end double"), ["k"], 60.0).collect()
    want = {(i, j): min(b, d) - max(a, c) for k, i, a, b in one for m, j, c, d in two if d is not None and b < float("inf") and k == m and a < d and c < b and min(b, d) > max(a, c)}
    assert len(got) == len(want) and all(want[(r["i"], r["j"])] == pytest.approx(r["overlap"]) for r in got)


def test_selection(spark):
    rows = [("P11", "placebo", 1, "P11D1"), ("P11", "DMT", 2, "P11D2"), ("P11", "DMT", 5, "P11D5"), ("P12", "placebo", 1, "P12D1"), ("P12", "DMT", 2, "P12D2")]
    df = spark.createDataFrame(rows, "subject string, condition string, d int, file string")
    got = {(r["subject"], r["condition"]): (r["selected"], r["dropped"]) for r in selection.select_preferred(df, ["subject", "condition"], selection.d5_preference(F.col("condition"), F.col("d"), F.col("file")), "file").collect()}
    assert got[("P11", "DMT")] == ("P11D5", "P11D2") and got[("P12", "DMT")] == ("P12D2", "")


def test_windows(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(6)] + [("b", 0, 3.0)], "g string, t int, v double")
    r = df.select("g", "t", windows.zscore(F.col("v"), ["g"]).alias("z"), windows.trailing_mean(F.col("v"), ["g"], ["t"]).alias("m"), windows.triangular_mean(F.col("v"), ["g"], ["t"], 3).alias("s"), windows.robust_scale(F.col("v"), ["g"]).alias("r"), windows.even_offsets(["g"], ["t"]).alias("o")).orderBy("g", "t").collect()
    assert r[5]["m"] == 3.5 and r[0]["s"] == pytest.approx(1 / 3) and r[2]["s"] == pytest.approx(2.0)
    assert r[6]["z"] is None and r[6]["r"] is None and r[6]["o"] == 0.0 and r[0]["o"] == -0.5 and r[5]["o"] == 0.5


def test_spline_beats_line_on_a_curve(spark):
    rng = random.Random(9)
    rows = [(f"S{s}", float(t), math.sin(t / 3) + 0.1 * s + rng.gauss(0, 0.1)) for s in range(6) for t in range(20)]
    df = spark.createDataFrame(rows, "subject string, t double, y double")
    line = mixed.fit_mixed_models(df, ["y"], {"t": F.col("t")}, strata=())
    curve = mixed.spline_terms("t", F.col("t"), [5.0, 10.0, 15.0])
    r = mixed.likelihood_ratio(line, mixed.fit_mixed_models(df, ["y"], curve, strata=()), ["outcome"], len(curve) - 1).first()
    assert r["statistic"] > 100 and r["p_value"] < 1e-10 and r["delta_aic"] < -50

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.functions import kernels as k
from epochloom.operators import segmentation as seg
from epochloom.operators import signals, staging


def test_runs_blocks_and_epochs(spark):
    """650 samples from 0 s and 800 from 75 s at 10 Hz, epochs of 30 s."""
    rows = [("r", i / 10) for i in range(650)] + [("r", 75 + i / 10) for i in range(800)]
    samples = spark.createDataFrame([*rows, ("r", None)], "rec string, t double")
    labelled = seg.label_runs(samples, "rec", "t", 0.1)
    runs = seg.run_table(labelled, "rec", "t", 300)
    assert [(r["n_epochs"], r["discarded_tail"]) for r in runs.orderBy("run_number").collect()] == [(2, 50), (2, 200)]
    for tolerance, blocks in ((90.0, 1), (10.0, 2)):
        placed = seg.context_blocks(runs, "rec", 0.1, tolerance)
        assert placed.select("block_number").distinct().count() == blocks
    placed = seg.context_blocks(runs, "rec", 0.1, 90.0)
    meta = seg.epoch_metadata(seg.whole_epochs(labelled, "rec", "t", 300), placed, "rec").orderBy("start_time").collect()
    assert [r["break_before"] for r in meta] == [False, False, True, False]
    assert meta[0]["gap_before_seconds"] is None and meta[2]["gap_before_seconds"] == pytest.approx(15.0)
    assert all(r["end_time"] - r["start_time"] == pytest.approx(29.9) for r in meta)
    facts = seg.block_facts(placed, "rec").first()
    assert facts["n_runs"] == 2 and facts["max_gap_seconds"] == pytest.approx(15.0) and len(facts["gaps"]) == 1
    assert seg.sampling_frequency(samples.withColumn("trial", (F.col("t") >= 75).cast("int")), "rec", "trial", "t").first()["sampling_frequency"] == pytest.approx(10.0)


def sine(f, rate=100.0, seconds=30, n=2):
    t = np.arange(int(rate * seconds)) / rate
    return np.stack([np.sin(2 * np.pi * f * t)] * n)


def test_spectrum_and_bands():
    f, p = k.welch(sine(10.0), 100.0)
    assert f[p[0].argmax()] == pytest.approx(10.0)
    assert k._area(p, f[1] - f[0])[0] == pytest.approx(0.5, rel=1e-2)  # the power of a sine
    shares = k.band_powers(f, p)
    assert shares["alpha"][0] > 0.95 and sum(v[0] for v in shares.values()) <= 1.3
    assert k.welch(np.zeros((3, 1)), 100.0)[1].shape == (3, 0)


def test_aperiodic_recovers_power_law():
    f = np.arange(1, 181) / 4
    p = 10**1.5 / f**1.7
    p[39] *= 50
    fit = k.aperiodic(f, p[None, :])
    assert fit["exponent"][0] == pytest.approx(1.7, abs=0.1) and fit["offset"][0] == pytest.approx(1.5, abs=0.1)
    assert np.isnan(k.aperiodic(f, np.zeros((1, 180)))["exponent"][0])


def test_filters_and_resampling():
    x = sine(2.0) + sine(20.0)
    assert np.allclose(k.bandpass(x, 100.0, None, 10.0)[:, 100:-100], sine(2.0)[:, 100:-100], atol=1e-2)
    y = k.resample_standardize(sine(2.0), 100.0, 50.0)
    assert y.shape[1] == 1500 and y.std(axis=1) == pytest.approx([1, 1]) and abs(y.mean()) < 1e-9
    assert not k.resample_standardize(np.ones((1, 8)), 4.0, 4.0).any()


def test_shape_features():
    h = k.hjorth(sine(5.0))
    assert h["complexity"][0] == pytest.approx(1.0, abs=0.05)
    assert k.zero_crossings(sine(5.0) + 1e-9)[0] == pytest.approx(300, abs=2)
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(1, 4000))
    assert k.higuchi(noise)[0] == pytest.approx(2.0, abs=0.1) and k.higuchi(np.cumsum(noise, axis=1))[0] == pytest.approx(1.5, abs=0.15)
    assert k.permutation_entropy(noise)[0] > 0.99 and k.permutation_entropy(np.arange(50.0)[None, :])[0] == 0
    assert len(k.staging_features(noise, 100.0)) == 21
    assert np.allclose(k.smooth_polynomial(np.arange(20.0)[None, :] ** 2), np.arange(20.0) ** 2)
    s = k.series_features(np.concatenate([noise, np.cumsum(noise, axis=1), np.ones((1, 4000))]))
    assert s["dfa"][0] == pytest.approx(0.5, abs=0.1) and s["dfa"][1] == pytest.approx(1.5, abs=0.2)
    assert all(np.isnan(v[2]) for v in s.values()) and s["acf_timescale"][1] > 20 * s["acf_timescale"][0]


def test_array_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, -2.0, 5.0, 1.0], "x"), (2, None, "x"), (3, [], "x"), (4, [1.0, None, 2.0], "x"), (5, [2.0], "x")], "id int, s array<double>, sd string")
    got = {r["id"]: r for r in signals.signal_features(df, ["id"], "s", ["std", "nothing"], lambda x: k.moments(x)).collect()}
    assert got[1]["std"] == pytest.approx(np.std([1, 3, -2, 5, 1], ddof=1)) and all(got[i]["std"] is None for i in (2, 3, 4, 5)) and got[1]["nothing"] is None
    r = df.where("id = 1").select(signals.array_zero_crossings(F.col("s")).alias("z"), signals.chunk_array(F.col("s"), 2).alias("c"), signals.array_standardize(F.col("s")).alias("n"), signals.reorder_array(F.col("s"), [4, 0]).alias("o")).first()
    assert r["z"] == 2 and r["c"] == [[1.0, 3.0], [-2.0, 5.0]] and np.std(r["n"]) == pytest.approx(1) and r["o"] == [1.0, 1.0]
    assert signals.spectra(df, ["id"], "s", 4.0).select("id").distinct().count() == 1


def test_predictors_and_qc(spark):
    rows = [("r", "b", e, 1.0, 1.0, 2.0, 0.0, None) for e in (1, 0)] + [("r", "bad", 0, 9.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "rec string, block string, epoch int, a double, b double, c double, d double, e double")

    def picky(x):
        if x[0, 0] == 9:
            raise RuntimeError("no weights")
        return staging.share_predictor(x)

    got = {(r["block"], r["epoch"]): r for r in staging.run_predictor(df, ["rec", "block"], "epoch", ["a", "b", "c", "d", "e"], picky, "mine").collect()}
    assert got[("b", 0)]["stage"] == "N2" and got[("b", 0)]["prob_n2"] == pytest.approx(0.5, abs=1e-5)
    assert "no weights" in got[("bad", 0)]["error"] and got[("bad", 0)]["prob_w"] is None or got[("bad", 0)]["prob_w"] != got[("bad", 0)]["prob_w"]
    epochs = spark.createDataFrame([("r", "x", e) for e in range(6)] + [("r", "y", 0)], "recording_id string, block_id string, epoch int")
    staged = spark.createDataFrame([("r", "x", "gssc", e) for e in range(6)], "recording_id string, block_id string, stager string, epoch int")
    qc = {(r["block_id"], r["stager"]): r["status"] for r in staging.staging_qc(epochs, staged, ["GSSC", "yasa", "gssc", "none"], {"gssc", "yasa"}, 5).collect()}
    assert qc == {("x", "gssc"): "ok", ("x", "yasa"): "failed", ("x", "none"): "not_configured", ("y", "gssc"): "insufficient_epochs", ("y", "yasa"): "unsupported_single_epoch", ("y", "none"): "not_configured"}


def test_series_features_of_a_signal_alone_and_in_a_batch():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=(20, 64))
    x = np.concatenate([noise, np.cumsum(noise, axis=1), np.sin(np.arange(64) * rng.uniform(0.05, 2, (20, 1))) + 0.1 * noise])
    mixed = k.series_features(x)
    for i in range(len(x)):
        alone = k.series_features(x[i : i + 1])
        assert all(alone[name][0] == v[i] or np.isnan(alone[name][0]) and np.isnan(v[i]) for name, v in mixed.items())
    assert all(len(v) == 1 for n in (2, 3, 5, 9) for v in k.series_features(noise[:1, :n]).values())


def test_series_features_follow_their_definitions():
    """Each against its definition written as plain loops over one signal."""
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=120), np.cumsum(rng.normal(size=121)), np.sin(np.arange(200) / 3) + 0.2 * rng.normal(size=200), rng.standard_t(2, size=90)):
        n = len(x)
        y = (x - x.mean()) / x.std(ddof=1)
        got = {name: v[0] for name, v in k.series_features(x[None, :]).items()}
        acf = [sum(y[i] * y[i + lag] for i in range(n - lag)) for lag in range(n)]
        zero = next(lag for lag in range(n) if acf[lag] <= 0)

        low, step = y.min() - 0.1, (y.max() - y.min() + 0.2) / 5
        joint = np.zeros((5, 5))
        for i in range(n - 2):
            joint[int((y[i] - low) / step), int((y[i + 2] - low) / step)] += 1 / (n - 2)
        ami = sum(joint[i, j] * np.log(joint[i, j] / joint[i].sum() / joint[:, j].sum()) for i in range(5) for j in range(5) if joint[i, j] > 0)
        assert got["ami2"] == pytest.approx(ami)

        lags = min(40, -(-n // 2))
        info = [-0.5 * np.log(1 - np.corrcoef(y[: n - lag], y[lag:])[0, 1] ** 2) for lag in range(1, lags + 1)]
        assert got["ami_timescale"] == next((i for i in range(1, lags - 1) if info[i] < info[i - 1] and info[i] < info[i + 1]), lags)

        thin = y[::zero]
        label = np.searchsorted(np.quantile(thin, [1 / 3, 2 / 3], method="hazen"), thin)
        moves = np.zeros((3, 3))
        for a, b in zip(label[:-1], label[1:], strict=True):
            moves[a, b] += 1 / (len(thin) - 1)
        assert got["transition_variance"] == pytest.approx(np.trace(np.cov(moves.T)))

        for name, w in (("outlier_timing_pos", y), ("outlier_timing_neg", -y)):
            middles, shares, alone = [], [], []
            for level in range(int(w.max() / 0.01 + 1)):
                over = np.flatnonzero(w >= level * 0.01) + 1
                middles.append(np.median(over) / (n / 2) - 1)
                shares.append((len(over) - 1) * 100 / (w >= 0).sum())
                alone.append(len(over) == 1)
            last = min(max(i for i, s in enumerate(shares) if s > 2), alone.index(True) if any(alone) else len(alone) - 1)
            assert got[name] == pytest.approx(np.median(middles[: last + 1]))

        lag = min(zero, n // 10)
        d = np.array([np.hypot(y[i + 1] - y[i], y[i + lag + 1] - y[i + lag]) for i in range(n - lag - 1)])
        counts, edges = np.histogram(d, int(np.ceil(np.ptp(d) / (3.5 * d.std(ddof=1) / len(d) ** (1 / 3)))))
        law = np.exp(-(edges[1:] + edges[:-1]) / 2 / d.mean()) / d.mean()
        assert got["embedding_dist"] == pytest.approx(np.abs(counts / len(d) - law).mean())

        runs = "".join("x" if v > 0 else " " for v in y[:-1])
        assert got["stretch_high"] - max(map(len, runs.split())) in (0, 1)  # counted from the sample before
        for name, rest, every in (("dfa_prop", lambda w: (w**2).mean(), 2), ("rs_range_prop", lambda w: np.ptp(w) ** 2, 1)):
            sizes = sorted({int(np.exp(np.log(5) + i * (np.log(n // 2) - np.log(5)) / 49) + 0.5) for i in range(50)})
            walk = np.cumsum(y[::every][: n // every])
            logs = []
            for s in sizes:
                parts = [walk[j * s : j * s + s] for j in range(len(walk) // s)]
                logs.append(np.log(np.sqrt(np.mean([rest(p - np.polyval(np.polyfit(np.arange(s), p, 1), np.arange(s))) for p in parts]))))
            t, v = np.log(sizes), np.array(logs)
            wrong = [sum(np.linalg.norm(v[c] - np.polyval(np.polyfit(t[c], v[c], 1), t[c])) for c in (slice(0, i), slice(i - 1, None))) for i in range(6, len(t) - 5)]
            assert got[name] == pytest.approx((np.argmin(wrong) + 6) / len(t))
    wave = k.series_features(np.sin(2 * np.pi * np.arange(240) / 24)[None, :])
    assert wave["periodicity"][0] == 23 and 0 <= wave["low_freq_power"][0] <= 1  # lag 24, counted from lag 1

"""Queries of the time-series operators: segmentation, rolling windows, signals, staging."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.functions import kernels
from epochloom.functions.probability import window_label
from epochloom.operators import segmentation as seg
from epochloom.operators import intervals, ranks, signals, staging, windows
from epochloom.plans import runs
from epochloom.plans.common import FT, PROBS, feats, query
from epochloom.plans.relational import WINDOWS
from epochloom.session import cut, drop_folder, shared_folder
from epochloom.sources.tables import clean_table, table
from epochloom.streaming import periods

STEP, PER_EPOCH, TOLERANCE = 30.0, 4, 90.0
#: Embeddings stand in for epochs of 64 samples.
RATE = 16.0

# Starts in whole milliseconds and whole steps, so both engines see the same numbers.
_SAMPLES = "t AS (SELECT DISTINCT recording_id, absolute_start AS t FROM epoch_metadata WHERE absolute_start IS NOT NULL AND NOT isnan(absolute_start))"
_RUNS = f"""{_SAMPLES}, b AS (SELECT *, coalesce(abs(t - lag(t) OVER (PARTITION BY recording_id ORDER BY t) - 30.0) > 3.0, false) AS break_before FROM t),
n AS (SELECT *, sum(break_before::INT) OVER (PARTITION BY recording_id ORDER BY t)::BIGINT AS run_number FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY recording_id, run_number ORDER BY t) - 1 AS position FROM n)"""
_EPOCHS = f"""{_RUNS}, e AS (SELECT recording_id, run_number, position // 4 AS epoch_in_run, min(t) AS start_time, max(t) AS end_time, median(t) AS label_time FROM p GROUP BY ALL HAVING count(*) = 4),
z AS (SELECT *, count(*) OVER (PARTITION BY recording_id, run_number) AS size FROM p),
r AS (SELECT recording_id, run_number, min(t) AS start_time, max(t) FILTER (position < size // 4 * 4) AS end_time, count(*) AS n_samples, count(*) // 4 AS n_epochs, count(*) % 4 AS discarded_tail FROM z GROUP BY ALL HAVING count(*) >= 4),
g AS (SELECT *, greatest(0.0, start_time - lag(end_time) OVER w - 30.0) AS g0, lag(end_time) OVER w IS NULL AS first FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY start_time)),
k AS (SELECT * EXCLUDE (g0, first), CASE WHEN NOT first THEN g0 END AS gap_seconds FROM g),
bl AS (SELECT *, sum(CASE WHEN gap_seconds > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_time)::BIGINT AS block_number FROM k)"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    starts = clean_table(spark, folder, "epoch_metadata").select("recording_id", F.col("absolute_start").alias("t")).distinct()
    return seg.label_runs(starts, "recording_id", "t", STEP)


@query(f"WITH {_RUNS} SELECT recording_id, t, break_before, run_number, position FROM p")
def gap_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_EPOCHS} SELECT recording_id, run_number, epoch_in_run, start_time, end_time, round(label_time, 6) AS label_time FROM e")
def whole_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return seg.whole_epochs(_labelled(spark, folder), "recording_id", "t", PER_EPOCH).withColumn("label_time", F.round("label_time", 6))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return seg.context_blocks(seg.run_table(_labelled(spark, folder), "recording_id", "t", PER_EPOCH), "recording_id", STEP, TOLERANCE)


@query(f"WITH {_EPOCHS} SELECT recording_id, run_number, start_time, end_time, n_samples, n_epochs, discarded_tail, round(gap_seconds, 6) AS gap_seconds, block_number FROM bl")
def gap_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _blocks(spark, folder).withColumn("gap_seconds", F.round("gap_seconds", 6))


@query(f"""WITH {_EPOCHS}, x AS (SELECT e.*, bl.block_number, bl.gap_seconds, row_number() OVER (PARTITION BY e.recording_id, bl.block_number ORDER BY e.start_time) - 1 AS epoch_in_block FROM e JOIN bl USING (recording_id, run_number))
SELECT recording_id, block_number, epoch_in_block, run_number, epoch_in_run, start_time, epoch_in_run = 0 AND epoch_in_block > 0 AS break_before, round(CASE WHEN epoch_in_block = 0 THEN NULL WHEN epoch_in_run = 0 THEN gap_seconds ELSE 0.0 END, 6) AS gap_before_seconds,
 CASE WHEN label_time >= 480 AND label_time < 840 THEN 'before' WHEN label_time >= 840 AND label_time < 2640 THEN 'after' WHEN label_time >= 2640 AND label_time < 3540 THEN 'late' ELSE 'outside' END AS label FROM x""")
def epoch_table(spark: SparkSession, folder: str) -> DataFrame:
    epochs = seg.whole_epochs(_labelled(spark, folder), "recording_id", "t", PER_EPOCH)
    out = seg.epoch_metadata(epochs, _blocks(spark, folder), "recording_id")
    return out.select("recording_id", "block_number", F.col("epoch_in_block").cast("long").alias("epoch_in_block"), "run_number", "epoch_in_run", "start_time", "break_before", F.round("gap_before_seconds", 6).alias("gap_before_seconds"), window_label(F.col("label_time"), WINDOWS).alias("label"))


@query(f"""WITH {_EPOCHS}, i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY recording_id, block_number ORDER BY start_time) > 1 THEN gap_seconds END AS inner_gap FROM bl)
SELECT recording_id, block_number, min(start_time) AS start_time, max(end_time) AS end_time, round(max(end_time) - min(start_time), 6) AS elapsed_seconds, count(*) AS n_runs, sum(n_epochs)::BIGINT AS n_epochs, sum(discarded_tail)::BIGINT AS discarded_tail, round(coalesce(max(inner_gap), 0.0), 6) AS max_gap_seconds, coalesce(string_agg(printf('%.3f', inner_gap), ';' ORDER BY start_time) FILTER (inner_gap IS NOT NULL), '') AS gaps FROM i GROUP BY ALL""")
def block_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = seg.block_facts(_blocks(spark, folder), "recording_id")
    text = F.array_join(F.transform("gaps", lambda g: F.format_string("%.3f", g)), ";")
    return facts.withColumns({"gaps": text, "elapsed_seconds": F.round("elapsed_seconds", 6), "max_gap_seconds": F.round("max_gap_seconds", 6)})


@query("""WITH u AS (SELECT recording_id, run_id, unnest(sample_times) AS t FROM continuous_runs), s AS (SELECT recording_id, run_id, t - lag(t) OVER (PARTITION BY recording_id, run_id ORDER BY t) AS d FROM u WHERE t IS NOT NULL),
m AS (SELECT recording_id, run_id, median(d) AS m FROM s WHERE d > 0 GROUP BY ALL) SELECT recording_id, round(1 / median(m), 6) AS sampling_frequency FROM m GROUP BY 1""")
def sampling_frequency(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "continuous_runs").select("recording_id", "run_id", F.explode("sample_times").alias("t")).where("t IS NOT NULL")
    return seg.sampling_frequency(samples, "recording_id", "run_id", "t").withColumn("sampling_frequency", F.round("sampling_frequency", 6))


_W = "WINDOW w AS (PARTITION BY recording_id, electrode)"
_KEYS = ["recording_id", "electrode", "block_id", "epoch"]
_ORDER = "ORDER BY absolute_start, block_id, epoch"


@query(f"WITH {FT} SELECT recording_id, electrode, block_id, epoch, round((specparam_exponent - avg(specparam_exponent) OVER w) / nullif(stddev_samp(specparam_exponent) OVER w, 0), 5) AS z FROM f {_W}")
def zscore_within(spark: SparkSession, folder: str) -> DataFrame:
    return feats(spark, folder).select(*_KEYS, F.round(windows.zscore(F.col("specparam_exponent"), ["recording_id", "electrode"]), 5).alias("z"))


@query(f"WITH {FT} SELECT recording_id, electrode, block_id, epoch, round(avg(specparam_exponent) OVER (PARTITION BY recording_id, electrode {_ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 7) AS rolling_mean FROM f")
def rolling4_mean(spark: SparkSession, folder: str) -> DataFrame:
    return feats(spark, folder).select(*_KEYS, F.round(windows.trailing_mean(F.col("specparam_exponent"), ["recording_id", "electrode"], ["absolute_start", "block_id", "epoch"]), 7).alias("rolling_mean"))


_TRI = [(k, 8 - abs(k)) for k in range(-7, 8)]
_NEAR = lambda k: f"lag(specparam_exponent, {-k}) OVER w" if k <= 0 else f"lead(specparam_exponent, {k}) OVER w"
_TOP = " + ".join(f"coalesce({_NEAR(k)} * {w}.0, 0.0)" for k, w in _TRI)
_BOTTOM = " + ".join(f"CASE WHEN ({_NEAR(k)}) IS NOT NULL THEN {w}.0 ELSE 0.0 END" for k, w in _TRI)


@query(f"WITH {FT} SELECT recording_id, electrode, block_id, epoch, round(({_TOP}) / nullif({_BOTTOM}, 0), 11) AS smoothed FROM f WINDOW w AS (PARTITION BY recording_id, electrode {_ORDER})")
def triangular15_mean(spark: SparkSession, folder: str) -> DataFrame:
    return feats(spark, folder).select(*_KEYS, F.round(windows.triangular_mean(F.col("specparam_exponent"), ["recording_id", "electrode"], ["absolute_start", "block_id", "epoch"]), 11).alias("smoothed"))


@query(f"WITH {FT} SELECT recording_id, electrode, block_id, epoch, round((bp_rel_delta - median(bp_rel_delta) OVER w) / nullif(quantile_cont(bp_rel_delta, 0.95) OVER w - quantile_cont(bp_rel_delta, 0.05) OVER w, 0), 5) AS scaled FROM f {_W}")
def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    return feats(spark, folder).select(*_KEYS, F.round(windows.robust_scale(F.col("bp_rel_delta"), ["recording_id", "electrode"]), 5).alias("scaled"))


@query(f"WITH {FT} SELECT recording_id, electrode, block_id, epoch, round(absolute_start / 3600, 7) AS time_hour, round(absolute_start / nullif(max(absolute_start) OVER w, 0), 7) AS time_norm FROM f {_W}")
def time_norm(spark: SparkSession, folder: str) -> DataFrame:
    return feats(spark, folder).select(*_KEYS, F.round(F.col("absolute_start") / 3600, 7).alias("time_hour"), F.round(windows.elapsed_share(F.col("absolute_start"), ["recording_id", "electrode"]), 7).alias("time_norm"))


@query("WITH k AS (SELECT rating_id, session, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY intensity NULLS FIRST, rating_id) - 1 AS k FROM (SELECT rating_id, session, CASE WHEN NOT isnan(intensity) THEN intensity END AS intensity FROM ratings)) SELECT rating_id, round(CASE WHEN n > 1 THEN k / nullif(n - 1, 0) - 0.5 ELSE 0 END, 7)::DOUBLE AS swarm_offset FROM k")
def swarm_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean_table(spark, folder, "ratings")
    order = [F.col("intensity").asc_nulls_first(), F.col("rating_id").asc()]
    return ranks.spread_offsets(rows.select("session", "rating_id", "intensity"), ["session"], order, "offset").select("rating_id", F.round("offset", 7).alias("swarm_offset"))


# Signals


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT *, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS d1 FROM e), g AS (SELECT *, list_transform(range(1, len(d1)), lambda i: d1[i + 1] - d1[i]) AS d2 FROM d)
SELECT vec_id, round(list_stddev_samp(x), 5) AS sd, list_sum(list_transform(range(1, len(x)), lambda i: CASE WHEN (x[i] < 0) <> (x[i + 1] < 0) THEN 1 ELSE 0 END))::INTEGER AS zero_crossings, round(sqrt(list_var_pop(d1) / nullif(list_var_pop(x), 0)), 5) AS mobility, round(sqrt(list_var_pop(d2) / nullif(list_var_pop(d1), 0)) / nullif(sqrt(list_var_pop(d1) / nullif(list_var_pop(x), 0)), 0), 5) AS complexity FROM g""")
def signal_shape(spark: SparkSession, folder: str) -> DataFrame:
    rows = _signals(spark, folder).withColumn("d1", signals.array_diff(F.col("x"))).withColumn("d2", signals.array_diff(F.col("d1")))
    v0, v1, v2 = (signals.array_var(F.col(c)) for c in ("x", "d1", "d2"))
    zero = F.lit(0.0)
    mobility = F.sqrt(v1 / F.nullif(v0, zero))
    return rows.select("vec_id", F.round(F.sqrt(signals.array_var(F.col("x"), 1)), 5).alias("sd"), signals.array_zero_crossings(F.col("x")).alias("zero_crossings"), F.round(mobility, 5).alias("mobility"), F.round(F.sqrt(v2 / F.nullif(v1, zero)) / F.nullif(mobility, zero), 5).alias("complexity"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT vec_id, unnest(range(0, len(x) // 16)) AS part, x FROM e) SELECT vec_id, part::INTEGER AS part, round(list_avg(x[part * 16 + 1 : part * 16 + 16]), 6) AS mean, x[part * 16 + 16] AS last_value, x[part * 16 + 1] AS first_value FROM c")
def signal_chunks(spark: SparkSession, folder: str) -> DataFrame:
    parts = _signals(spark, folder).select("vec_id", F.posexplode(signals.chunk_array(F.col("x"), 16)).alias("part", "c"))
    ends = signals.reorder_array(F.col("c"), [15, 0])
    return parts.select("vec_id", "part", F.round(signals.array_mean(F.col("c")), 6).alias("mean"), ends[0].alias("last_value"), ends[1].alias("first_value"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS i, list_avg(x) AS m, list_stddev_pop(x) AS s FROM e) SELECT vec_id, i::INTEGER AS position, round(CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END, 5) AS value FROM u")
def signal_standardised(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select("vec_id", F.posexplode(signals.array_standardize(F.col("x"))).alias("position", "value")).withColumn("value", F.round("value", 5))


def _spectrum_sql(rate: float) -> str:
    """CTE p (vec_id, k, f, power): one Hann window over the 64 samples of each signal, by the sums of the transform."""
    wave = lambda g: f"list_sum(list_transform(range(0, 64), lambda i: w[i + 1] * {g}(2 * pi() * k * i / 64)))"
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) = 64), m AS (SELECT vec_id, x, list_avg(x) AS mean FROM e),
w AS (SELECT vec_id, list_transform(range(0, 64), lambda i: (x[i + 1] - mean) * (0.5 - 0.5 * cos(2 * pi() * i / 64))) AS w FROM m), t AS (SELECT vec_id, unnest(range(0, 33)) AS k, w FROM w),
s AS (SELECT vec_id, k, {wave('cos')} AS a, {wave('sin')} AS b FROM t),
p AS (SELECT vec_id, k, k * {rate} / 64 AS f, (a * a + b * b) / ({rate} * 24.0) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS power FROM s)"""


def _area_sql(low: float, high: float, rate: float) -> str:
    return f"coalesce(sum((power + next) / 2 * {rate / 64}) FILTER (f >= {low} AND f + {rate / 64} <= {high}), 0)"


_NEXT = "n AS (SELECT *, lead(power) OVER (PARTITION BY vec_id ORDER BY k) AS next FROM p)"
_QUARTERS = {"delta": (0.5, 2.0), "theta": (2.0, 4.0), "alpha": (4.0, 6.0), "beta": (6.0, 8.0)}


@query(f"WITH {_spectrum_sql(RATE)} SELECT vec_id, f::DOUBLE AS frequency_hz, round(power, 9) AS power FROM p")
def welch_spectra(spark: SparkSession, folder: str) -> DataFrame:
    return signals.spectra(_signals(spark, folder), ["vec_id"], "x", RATE).withColumn("power", F.round("power", 9))


@query(f"WITH {_spectrum_sql(RATE)}, {_NEXT} SELECT vec_id, " + ", ".join(f"round({_area_sql(a, b, RATE)} / {_area_sql(0.5, 8.0, RATE)}, 8) AS {name}" for name, (a, b) in _QUARTERS.items()) + " FROM n GROUP BY 1")
def relative_band_power(spark: SparkSession, folder: str) -> DataFrame:
    shares = signals.signal_features(_signals(spark, folder), ["vec_id"], "x", list(_QUARTERS), lambda x: kernels.band_powers(*kernels.welch(x, RATE), _QUARTERS))
    return shares.withColumns({b: F.round(b, 8) for b in _QUARTERS})


@query()
def aperiodic_fit(spark: SparkSession, folder: str) -> DataFrame:
    return signals.signal_features(_signals(spark, folder), ["vec_id"], "x", ["offset", "exponent", "r2", "error"], lambda x: kernels.aperiodic(*kernels.welch(x, RATE), 0.5, 8.0))


STAGING_NAMES = [*kernels.moments(np.ones((1, 4))), "nzc", "hmob", "hcomp", *kernels.STAGING_BANDS, "dt", "ds", "db", "at", "abspow", "perm", "higuchi", "petrosian"]


@query()
def staging_features(spark: SparkSession, folder: str) -> DataFrame:
    return signals.signal_features(_signals(spark, folder), ["vec_id"], "x", STAGING_NAMES, lambda x: kernels.staging_features(x, 64.0, 1.0))


_BAND = lambda name: _area_sql(*kernels.STAGING_BANDS[name], 64.0)


@query(f"WITH {_spectrum_sql(64.0)}, {_NEXT}, b AS (SELECT vec_id, {', '.join(f'{_BAND(b)} AS {b}' for b in kernels.STAGING_BANDS)}, {_area_sql(0.4, 30.0, 64.0)} AS wide FROM n GROUP BY 1) SELECT vec_id, round((sdelta + fdelta) / theta, 5) AS dt, round((sdelta + fdelta) / sigma, 5) AS ds, round((sdelta + fdelta) / beta, 5) AS db, round(alpha / theta, 5) AS at, round(wide, 9) AS abspow FROM b")
def staging_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios between the bands of the staging features, and their absolute power."""
    rows = staging_features(spark, folder)
    return rows.select("vec_id", *[F.round(c, 5).alias(c) for c in ("dt", "ds", "db", "at")], F.round("abspow", 9).alias("abspow"))


SERIES_NAMES = sorted(kernels.series_features(np.sin(np.arange(64.0))[None, :] + np.arange(64.0) % 5))


@query()
def series_features(spark: SparkSession, folder: str) -> DataFrame:
    return signals.signal_features(_signals(spark, folder), ["vec_id"], "x", SERIES_NAMES, kernels.series_features)


@query()
def filtered_signal_spread(spark: SparkSession, folder: str) -> DataFrame:
    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"sd_band": kernels.bandpass(x, RATE, 0.5, 6.0).std(axis=1), "sd_half_rate": kernels.resample_standardize(x, RATE, RATE / 2).std(axis=1)}

    return signals.signal_features(_signals(spark, folder), ["vec_id"], "x", ["sd_band", "sd_half_rate"], kernel)


@query("""WITH e AS (SELECT recording_id, block_id, count(*) AS expected_epochs FROM (SELECT DISTINCT recording_id, block_id, epoch_in_block FROM epoch_metadata) GROUP BY ALL), s AS (SELECT unnest(['gssc', 'sleepfm', 'yasa', 'other']) AS stager),
g AS (SELECT e.*, stager FROM e, s), r AS (SELECT recording_id, block_id, stager, count(DISTINCT epoch) AS returned_epochs FROM hypnodensities GROUP BY ALL)
SELECT g.recording_id, g.block_id, g.stager, expected_epochs, coalesce(returned_epochs, 0) AS returned_epochs,
 CASE WHEN stager = 'other' THEN 'not_configured' WHEN expected_epochs = 1 AND stager = 'yasa' THEN 'unsupported_single_epoch' WHEN expected_epochs < 5 THEN 'insufficient_epochs' WHEN coalesce(returned_epochs, 0) = 0 THEN 'failed' ELSE 'ok' END AS status
FROM g LEFT JOIN r USING (recording_id, block_id, stager)""")
def staging_qc(spark: SparkSession, folder: str) -> DataFrame:
    epochs = table(spark, folder, "epoch_metadata").select("recording_id", "block_id", F.col("epoch_in_block").alias("epoch"))
    return staging.staging_qc(epochs, table(spark, folder, "hypnodensities"), ["gssc", "sleepfm", "yasa", "other"], configured={"gssc", "sleepfm", "yasa"}, least_epochs=5)


@query()
def predicted_states(spark: SparkSession, folder: str) -> DataFrame:
    """A pluggable predictor over the blocks of the features table, as probability rows with metadata."""
    rows = feats(spark, folder)
    return staging.run_predictor(rows, ["recording_id", "block_id", "electrode"], "epoch", ["bp_rel_delta", "bp_rel_theta", "bp_rel_alpha", "bp_rel_sigma", "bp_rel_beta"], staging.share_predictor, "share").select("recording_id", "block_id", "electrode", "epoch", "stager", *PROBS, "stage", "error")


@query(f"WITH {_EPOCHS}, tol AS (SELECT unnest([0, 15, 30, 60, 90, 120])::DOUBLE AS tolerance) SELECT recording_id, tolerance, count(*) FILTER (gap_seconds > tolerance) + 1 AS n_blocks, sum(n_epochs)::BIGINT AS n_epochs FROM bl, tol GROUP BY ALL")
def tolerance_sweep(spark: SparkSession, folder: str) -> DataFrame:
    table_of_runs = seg.run_table(_labelled(spark, folder), "recording_id", "t", PER_EPOCH)
    return runs.tolerance_sweep(table_of_runs, "recording_id", STEP, [0, 15, 30, 60, 90, 120])


@query("""WITH e AS (SELECT recording_id, CAST(round(absolute_start * 1000) AS BIGINT) AS s, CAST(round(absolute_end * 1000) AS BIGINT) AS e FROM epoch_metadata WHERE absolute_start IS NOT NULL AND absolute_end >= absolute_start AND NOT isnan(absolute_start) AND NOT isnan(absolute_end)),
w AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT recording_id, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY recording_id, k""")
def stream_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Periods from a stream of epochs: streamed pieces per bucket, then merged across buckets."""
    path = f"{folder}/epoch_metadata.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    rows = source.select(F.col("recording_id").alias("key"), intervals.to_ms(F.col("absolute_start")).alias("start_ms"), intervals.to_ms(F.col("absolute_end")).alias("end_ms"))
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    periods.run_to_table(periods.stream_pieces(rows, 6.0), f"{where}/out", f"{where}/checkpoint")
    pieces = cut(periods.latest(spark.read.parquet(f"{where}/out")))
    drop_folder(spark, where)
    tolerance = pieces.select("key", F.lit(6.0).alias("tolerance")).distinct()
    merged = intervals.merge_intervals(pieces, "key", "start_ms", "end_ms", tolerance)
    return merged.where("kind = 'period'").select(F.col("key").alias("recording_id"), "start_ms", "end_ms")


@query()
def extract_features(spark: SparkSession, folder: str) -> DataFrame:
    """All analyses of every signal in one pass over it, at a rate at which all bands exist."""
    return signals.extract_features(_signals(spark, folder), ["vec_id"], "x", 128.0, list(signals.ANALYSES), (2.0, 45.0))

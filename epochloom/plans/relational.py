"""Queries of the relational operators: scans, predicates, joins, aggregates, reshaping, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochloom.functions import probability as pr
from epochloom.operators import changes, checks, joins, reshape, select, selection, windows
from epochloom.operators.ranks import safe_corr
from epochloom.plans.common import BANDS, FEATURES, FT, H, PROBS, SP, each, feats, hyp, mean_of_millionths, mean_sql, nn, query, rounded, spectrum
from epochloom.sources.tables import clean_table, table

ENTITY = ["subject", "condition", "electrode", "stager"]

# Scans, predicates, projections


@query(f"SELECT row_id, round(-({each('CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END', PROBS, ' + ')}), 6) AS entropy, round(-({each('CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END', PROBS, ' + ')}) / ln(5), 6) AS entropy_normalized FROM hypnodensities WHERE {each('{c} BETWEEN 0 AND 1', PROBS, ' AND ')} AND abs({' + '.join(PROBS)} - 1.0) <= 1e-5")
def entropy(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hypnodensities").where(pr.valid_probabilities(PROBS))
    return rounded(rows.select("row_id", pr.entropy(PROBS).alias("entropy"), pr.entropy(PROBS, True).alias("entropy_normalized")), "entropy", "entropy_normalized")


_CLEAN = ", ".join(nn(p) for p in PROBS)


@query(f"WITH c AS (SELECT row_id, {', '.join(f'{nn(p)} AS {p}' for p in PROBS)} FROM hypnodensities) SELECT row_id, CASE {each('WHEN {c} = greatest(' + ', '.join(PROBS) + ") THEN upper(substr('{c}', 6))", PROBS, ' ')} END AS top_stage FROM c")
def stage_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hypnodensities").select("row_id", pr.argmax_label(PROBS, [s.upper() for s in pr.STAGES]).alias("top_stage"))


@query(f"""
SELECT stager, count(*) AS n_rows, count(*) FILTER ({each('{c} IS NULL OR isnan({c})', PROBS, ' OR ')}) AS n_missing,
       count(*) FILTER ({each('({c} IS NOT NULL AND NOT isnan({c}) AND ({c} < 0 OR {c} > 1))', PROBS, ' OR ')}) AS n_out_of_range,
       count(*) FILTER (NOT coalesce({each('{c} BETWEEN 0 AND 1', PROBS, ' AND ')} AND abs({' + '.join(PROBS)} - 1.0) <= 1e-5, false)) AS n_invalid
FROM hypnodensities GROUP BY stager""")
def probability_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hypnodensities")
    missing = reduce(lambda a, b: a | b, [F.col(p).isNull() | F.isnan(p) for p in PROBS])
    outside = reduce(lambda a, b: a | b, [F.coalesce(~F.isnan(p) & ((F.col(p) < 0) | (F.col(p) > 1)), F.lit(False)) for p in PROBS])
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.groupBy("stager").agg(F.count(F.lit(1)).alias("n_rows"), count(missing, "n_missing"), count(outside, "n_out_of_range"), count(~F.coalesce(pr.valid_probabilities(PROBS), F.lit(False)), "n_invalid"))


@query("SELECT recording_id, block_id, epoch, channel_set, round(prob_n1 + prob_r, 6) AS light, round(prob_n2 + prob_n3, 6) AS deep FROM (WITH " + H + " SELECT * FROM h) WHERE stager = 'gssc' AND condition IN ('DMT', 'placebo') AND electrode IS NOT NULL AND experimental_label <> 'outside'")
def filtered_sums(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).where((F.col("stager") == "gssc") & F.col("condition").isin("DMT", "placebo") & F.col("electrode").isNotNull() & (F.col("experimental_label") != "outside"))
    return rows.select("recording_id", "block_id", "epoch", "channel_set", F.round(F.col("prob_n1") + F.col("prob_r"), 6).alias("light"), F.round(F.col("prob_n2") + F.col("prob_n3"), 6).alias("deep"))


@query("SELECT row_id, bp_rel_alpha, specparam_exponent, yasa_eeg_std FROM features WHERE bp_rel_alpha IS NOT NULL AND NOT isnan(bp_rel_alpha) AND specparam_exponent IS NOT NULL AND NOT isnan(specparam_exponent) AND yasa_eeg_std IS NOT NULL AND NOT isnan(yasa_eeg_std) AND NOT isinf(yasa_eeg_std)")
def finite_features(spark: SparkSession, folder: str) -> DataFrame:
    values = ["bp_rel_alpha", "specparam_exponent", "yasa_eeg_std"]
    rows = clean_table(spark, folder, "features").select("row_id", *values)
    return rows.withColumns({c: F.when(F.abs(c) != float("inf"), F.col(c)) for c in values}).na.drop(subset=values)


@query("SELECT electrode, el_10_20 FROM electrodes WHERE (el_10_20 LIKE '%z' OR el_10_20 LIKE '%1' OR el_10_20 LIKE '%2' OR el_10_20 LIKE 'PO%') AND el_10_20 <> 'Iz'")
def montage_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return joins.montage(table(spark, folder, "electrodes")).select("electrode", "el_10_20")


WINDOWS = {"before": (480.0, 840.0), "after": (840.0, 2640.0), "late": (2640.0, 3540.0)}
_LABEL = "CASE WHEN label_time >= 480 AND label_time < 840 THEN 'before' WHEN label_time >= 840 AND label_time < 2640 THEN 'after' WHEN label_time >= 2640 AND label_time < 3540 THEN 'late' ELSE 'outside' END"


@query(f"SELECT row_id, {_LABEL} AS window_label, experimental_label IS NOT NULL AND experimental_label <> {_LABEL} AS disagrees FROM epoch_metadata")
def window_label(spark: SparkSession, folder: str) -> DataFrame:
    pr.check_windows(WINDOWS)
    label = pr.window_label(F.col("label_time"), WINDOWS)
    stated = F.col("experimental_label")
    return table(spark, folder, "epoch_metadata").select("row_id", label.alias("window_label"), (stated.isNotNull() & (stated != label)).alias("disagrees"))


@query(r"SELECT recording_id, regexp_extract(recording_id, 'REC_(P[0-9]+)(D[0-9]+)', 1) AS parsed_subject, regexp_extract(recording_id, 'REC_(P[0-9]+)(D[0-9]+)', 2) AS parsed_session, CASE WHEN regexp_extract(recording_id, 'REC_(P[0-9]+)(D[0-9]+)', 2) = 'D1' THEN 'placebo' ELSE 'DMT' END AS parsed_condition FROM recordings")
def parse_names(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda i: F.regexp_extract("recording_id", r"REC_(P[0-9]+)(D[0-9]+)", i)
    return table(spark, folder, "recordings").select("recording_id", part(1).alias("parsed_subject"), part(2).alias("parsed_session"), F.when(part(2) == "D1", "placebo").otherwise("DMT").alias("parsed_condition"))


@query("WITH m AS (SELECT subject, condition, min(absolute_start) AS first FROM hypnodensities GROUP BY 1, 2), l AS (SELECT subject, max(first) AS begin FROM m GROUP BY 1) SELECT row_id FROM hypnodensities JOIN l USING (subject) WHERE absolute_start >= begin")
def common_start_trim(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hypnodensities").select("row_id", "subject", "condition", "absolute_start")
    begin = rows.groupBy("subject", "condition").agg(F.min("absolute_start").alias("first")).groupBy("subject").agg(F.max("first").alias("begin"))
    return rows.join(begin, "subject").where("absolute_start >= begin").select("row_id")


# Joins


@query(f"WITH {H}, {FT} SELECT h.recording_id, h.block_id, h.epoch, h.electrode, h.stager, h.channel_set, prob_w, bp_rel_alpha, specparam_exponent, el_10_20 FROM h LEFT JOIN f USING (recording_id, block_id, epoch, electrode) WHERE h.electrode IS NOT NULL")
def join_features_probs(spark: SparkSession, folder: str) -> DataFrame:
    joined = joins.features_with_probabilities(feats(spark, folder), hyp(spark, folder))
    return joined.select("recording_id", "block_id", "epoch", "electrode", "stager", "channel_set", "prob_w", "bp_rel_alpha", "specparam_exponent", "el_10_20")


@query(f"WITH {H}, {FT} SELECT DISTINCT recording_id, block_id, epoch, electrode FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.recording_id = h.recording_id AND f.block_id = h.block_id AND f.epoch = h.epoch AND f.electrode IS NOT DISTINCT FROM h.electrode)")
def strict_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).select(*joins.EPOCH_KEYS).distinct()
    return joins.unmatched(rows, feats(spark, folder), joins.EPOCH_KEYS)


@query("SELECT DISTINCT h.recording_id, h.block_id FROM hypnodensities h WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.recording_id = h.recording_id AND b.block_id = h.block_id)")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hypnodensities").select("recording_id", "block_id").distinct()
    return joins.unmatched(rows, table(spark, folder, "blocks"), ["recording_id", "block_id"])


@query("WITH l AS (SELECT electrode, any_value(el_10_20) AS label FROM electrodes GROUP BY 1) SELECT row_id, l.label FROM features f LEFT JOIN l USING (electrode)")
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    # 64 electrodes by the table's definition; Spark still decides how to join.
    labels = table(spark, folder, "electrodes").groupBy("electrode").agg(F.max("el_10_20").alias("label"))
    return table(spark, folder, "features").select("row_id", "electrode").join(labels, "electrode", "left").select("row_id", "label")


@query("""WITH s AS (SELECT DISTINCT channel_set FROM hypnodensities), u AS (SELECT channel_set, unnest(string_split(channel_set, '+')) AS e, generate_subscripts(string_split(channel_set, '+'), 1) AS i FROM s)
SELECT channel_set, string_agg(coalesce(l.el_10_20, e), '+' ORDER BY i) AS channel_set_10_20 FROM u LEFT JOIN electrodes l ON l.electrode = e GROUP BY channel_set""")
def channel_set_relabel(spark: SparkSession, folder: str) -> DataFrame:
    mapping = table(spark, folder, "electrodes").where("el_10_20 IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("electrode", "el_10_20"))).alias("m"))
    sets = table(spark, folder, "hypnodensities").select("channel_set").distinct()
    # The 64 electrodes of the table as one map, by a scalar subquery.
    return sets.withColumn("m", mapping.scalar()).select("channel_set", joins.relabel_set(F.col("channel_set"), F.col("m")).alias("channel_set_10_20"))


@query("WITH e AS (SELECT DISTINCT recording_id, block_id, epoch_in_block FROM epoch_metadata), c AS (SELECT DISTINCT recording_id, electrode FROM features) SELECT recording_id, electrode, count(*) AS n_cells FROM e JOIN c USING (recording_id) GROUP BY ALL")
def epoch_grid(spark: SparkSession, folder: str) -> DataFrame:
    epochs = table(spark, folder, "epoch_metadata").select("recording_id", "block_id", "epoch_in_block").distinct()
    electrodes = table(spark, folder, "features").select("recording_id", "electrode").distinct()
    return joins.epoch_grid(epochs, electrodes).groupBy("recording_id", "electrode").agg(F.count(F.lit(1)).alias("n_cells"))


_RATED = """r AS (SELECT rating_id, upper(trim(subject)) AS subject, session, 840 + 60 * timepoint AS l_start, 900 + 60 * timepoint AS l_end, intensity FROM ratings WHERE subject IS NOT NULL AND timepoint IS NOT NULL AND NOT isnan(timepoint)),
e AS (SELECT DISTINCT subject, session, stager, channel_set, absolute_start AS r_start, absolute_end AS r_end, prob_w FROM h WHERE absolute_end IS NOT NULL),
o AS (SELECT rating_id, intensity, stager, channel_set, r_start, prob_w, least(l_end, r_end) - greatest(l_start, r_start) AS overlap FROM r JOIN e ON r.subject = e.subject AND r.session = e.session AND l_start < r_end AND r_start < l_end)"""


def _rated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    start = 840 + 60 * F.nanvl("timepoint", F.lit(None))
    ratings = table(spark, folder, "ratings").select("rating_id", F.upper(F.trim("subject")).alias("subject"), "session", start.alias("l_start"), (start + 60).alias("l_end"), "intensity").where("subject IS NOT NULL AND l_start IS NOT NULL")
    epochs = hyp(spark, folder).select("subject", "session", "stager", "channel_set", F.col("absolute_start").alias("r_start"), F.col("absolute_end").alias("r_end"), "prob_w").where("r_end IS NOT NULL").distinct()
    return ratings, joins.overlap_pairs(ratings, epochs, ["subject", "session"], 60.0)


@query(f"WITH {H}, {_RATED} SELECT rating_id, stager, channel_set, r_start AS epoch_start, round(overlap, 6) AS overlap FROM o")
def overlap_pairing(spark: SparkSession, folder: str) -> DataFrame:
    return _rated(spark, folder)[1].select("rating_id", "stager", "channel_set", F.col("r_start").alias("epoch_start"), F.round("overlap", 6).alias("overlap"))


@query(f"WITH {H}, {_RATED} SELECT r.rating_id, count(o.rating_id) AS n_epochs, round(coalesce(sum(overlap), 0), 6) AS overlap_seconds, count(DISTINCT channel_set) AS n_channel_sets, coalesce(sum(overlap), 0) > 0 AS valid FROM r LEFT JOIN o USING (rating_id) GROUP BY 1")
def overlap_coverage(spark: SparkSession, folder: str) -> DataFrame:
    ratings, pairs = _rated(spark, folder)
    sums = pairs.groupBy("rating_id").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("s"), F.countDistinct("channel_set").alias("c"))
    total = F.coalesce("s", F.lit(0.0))
    return ratings.select("rating_id").join(sums, "rating_id", "left").select("rating_id", F.coalesce("n", F.lit(0)).alias("n_epochs"), F.round(total, 6).alias("overlap_seconds"), F.coalesce("c", F.lit(0)).alias("n_channel_sets"), (total > 0).alias("valid"))


@query(f"WITH {H}, {_RATED} SELECT rating_id, stager, round(sum(prob_w * overlap) / sum(overlap), 6) AS prob_w FROM o GROUP BY ALL")
def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _rated(spark, folder)[1]
    return pairs.groupBy("rating_id", "stager").agg(F.round(F.sum(F.col("prob_w") * F.col("overlap")) / F.sum("overlap"), 6).alias("prob_w"))


# Aggregations

_AVG5 = ", ".join(f"{mean_sql(p)} AS mean_{p}" for p in PROBS)


def _means() -> list:
    return [mean_of_millionths(p).alias(f"mean_{p}") for p in PROBS]



@query(f"WITH {H} SELECT subject, condition, experimental_label, electrode, stager, {_AVG5} FROM h GROUP BY ALL")
def phase_means(spark: SparkSession, folder: str) -> DataFrame:
    return hyp(spark, folder).groupBy("subject", "condition", "experimental_label", "electrode", "stager").agg(*_means())


_ENT = "-(" + each("CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END", PROBS, " + ") + ")"


@query(f"WITH {H}, e AS (SELECT *, {_ENT} AS entropy FROM h) SELECT condition, experimental_label, stager, count(*) AS n_rows, {', '.join(f'{mean_sql(c)} AS {c}_mean, round(stddev_samp({c}), 7) AS {c}_sd' for c in PROBS)}, round(avg(entropy), 7) AS entropy_mean, round(stddev_samp(entropy), 7) AS entropy_sd FROM e GROUP BY ALL")
def summarize_probs(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).withColumn("entropy", pr.entropy(PROBS))
    return rows.groupBy("condition", "experimental_label", "stager").agg(F.count(F.lit(1)).alias("n_rows"), *[a for c in PROBS for a in (mean_of_millionths(c).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 7).alias(f"{c}_sd"))], F.round(F.avg("entropy"), 7).alias("entropy_mean"), F.round(F.stddev_samp("entropy"), 7).alias("entropy_sd"))


@query(f"WITH {H}, e AS (SELECT condition, experimental_label, stager, electrode, {each('avg({c}) AS {c}', PROBS)} FROM h WHERE electrode IS NOT NULL GROUP BY ALL) SELECT condition, experimental_label, stager, {each('round(var_samp({c}), 8) AS var_{c}', PROBS)} FROM e GROUP BY ALL")
def electrode_variance(spark: SparkSession, folder: str) -> DataFrame:
    means = hyp(spark, folder).where("electrode IS NOT NULL").groupBy("condition", "experimental_label", "stager", "electrode").agg(*[F.avg(p).alias(p) for p in PROBS])
    return means.groupBy("condition", "experimental_label", "stager").agg(*[F.round(F.var_samp(p), 8).alias(f"var_{p}") for p in PROBS])


@query(f"WITH {FT} SELECT condition, count(bp_rel_alpha) AS n, round(avg(bp_rel_alpha), 6) AS mean, round(stddev_samp(bp_rel_alpha) / sqrt(count(bp_rel_alpha)), 8) AS standard_error FROM f GROUP BY 1")
def mean_standard_error(spark: SparkSession, folder: str) -> DataFrame:
    c = "bp_rel_alpha"
    return feats(spark, folder).groupBy("condition").agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c) / F.sqrt(F.count(c)), 8).alias("standard_error"))


@query("SELECT condition, count(DISTINCT recording_id) AS n_recordings, count(DISTINCT block_id) AS n_blocks, count(DISTINCT subject) AS n_subjects, count(DISTINCT CASE WHEN stage = 'R' THEN subject END) AS n_subjects_r FROM hypnodensities GROUP BY 1")
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = F.countDistinct
    return table(spark, folder, "hypnodensities").groupBy("condition").agg(d("recording_id").alias("n_recordings"), d("block_id").alias("n_blocks"), d("subject").alias("n_subjects"), d(F.when(F.col("stage") == "R", F.col("subject"))).alias("n_subjects_r"))


@query("SELECT subject, count(*) FILTER (condition = 'DMT') AS n_treated, count(*) FILTER (condition = 'placebo') AS n_control, count(DISTINCT condition) = 2 AS has_both FROM recordings GROUP BY 1")
def presence_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("condition")
    return table(spark, folder, "recordings").groupBy("subject").agg(F.count(F.when(c == "DMT", 1)).alias("n_treated"), F.count(F.when(c == "placebo", 1)).alias("n_control"), (F.countDistinct(c) == 2).alias("has_both"))


@query("SELECT feature_status, condition, count(*) AS n_blocks FROM blocks GROUP BY ALL")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").groupBy("feature_status", "condition").agg(F.count(F.lit(1)).alias("n_blocks"))


@query("SELECT subject, count(*) AS n_epochs, count(DISTINCT block_id) AS n_blocks FROM (SELECT DISTINCT subject, recording_id, block_id, epoch FROM hypnodensities) GROUP BY 1")
def unique_epoch_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hypnodensities").dropDuplicates(["subject", "recording_id", "block_id", "epoch"])
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n_epochs"), F.countDistinct("block_id").alias("n_blocks"))


@query(f"WITH {H}, s AS (SELECT subject FROM h WHERE experimental_label IN ('before', 'after') AND condition IS NOT NULL GROUP BY 1 HAVING count(DISTINCT condition || '/' || experimental_label) = 4) SELECT subject, condition, experimental_label, count(*) AS n_rows FROM h SEMI JOIN s USING (subject) WHERE experimental_label IN ('before', 'after') AND condition IS NOT NULL GROUP BY ALL")
def complete_subjects(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).where("experimental_label IN ('before', 'after') AND condition IS NOT NULL")
    return changes.complete_entities(rows, "subject", ["condition", "experimental_label"], 4).groupBy("subject", "condition", "experimental_label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT recording_id, block_id, epoch, electrode, frequency_hz, count(*) AS n_rows FROM spectra GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, folder, "spectra"), ["recording_id", "block_id", "epoch", "electrode", "frequency_hz"])


@query(f"WITH {FT} SELECT experimental_label, round(median(bp_rel_alpha), 6) AS median_alpha, min(absolute_start) AS first_start, max(absolute_end) AS last_end, round(quantile_cont(abs(specparam_exponent), 0.95), 6) AS cap FROM f GROUP BY 1")
def medians_and_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows, by = feats(spark, folder), ["experimental_label"]
    ends = rows.groupBy(*by).agg(F.min("absolute_start").alias("first_start"), F.max("absolute_end").alias("last_end"))
    middle = select.percentiles(rows, by, "bp_rel_alpha", [0.5]).select(*by, F.round(F.col("p")[0], 6).alias("median_alpha"))
    cap = select.percentiles(rows.withColumn("size", F.abs("specparam_exponent")), by, "size", [0.95]).select(*by, F.round(F.col("p")[0], 6).alias("cap"))
    return checks.join_null_safe(checks.join_null_safe(ends, middle, by, "left"), cap, by, "left")


@query("SELECT recording_id, string_agg(block_id, ';' ORDER BY block_id) AS blocks FROM (SELECT DISTINCT recording_id, block_id FROM blocks) GROUP BY 1")
def joined_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_set("block_id")), ";").alias("blocks"))


@query("WITH d AS (SELECT DISTINCT recording_id, block_id, start_time, end_time, n_epoch_runs, n_epochs, discarded_tail_samples, max_context_gap_seconds FROM blocks) SELECT recording_id, count(*) AS n_blocks, sum(n_epochs)::BIGINT AS n_epochs, coalesce(max(CASE WHEN NOT isnan(max_context_gap_seconds) THEN max_context_gap_seconds END), 0) AS max_gap, sum(discarded_tail_samples)::BIGINT AS discarded FROM d GROUP BY 1")
def block_qc(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "blocks").select("recording_id", "block_id", "start_time", "end_time", "n_epoch_runs", "n_epochs", "discarded_tail_samples", "max_context_gap_seconds").distinct()
    gap = F.when(~F.isnan("max_context_gap_seconds"), F.col("max_context_gap_seconds"))
    return rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_epochs").alias("n_epochs"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"), F.sum("discarded_tail_samples").alias("discarded"))


@query(f"WITH {H} SELECT stager, condition, epoch, {_AVG5} FROM h GROUP BY ALL")
def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    return hyp(spark, folder).groupBy("stager", "condition", "epoch").agg(*_means())


@query(f"WITH {H} SELECT recording_id, stager, channel_set, epoch // 6 AS token_epoch, count(*) AS n_tokens, {_AVG5} FROM h GROUP BY ALL")
def token_to_epoch_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).withColumn("token_epoch", F.floor(F.col("epoch") / 6).cast("int"))
    return rows.groupBy("recording_id", "stager", "channel_set", "token_epoch").agg(F.count(F.lit(1)).alias("n_tokens"), *_means())


_PROFILE = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS mid, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high"


@query(f"WITH {FT}, u AS (UNPIVOT (SELECT {', '.join(BANDS)} FROM f) ON {', '.join(BANDS)} INTO NAME feature VALUE x) SELECT feature, {_PROFILE} FROM u GROUP BY 1")
def numeric_profile(spark: SparkSession, folder: str) -> DataFrame:
    long = feats(spark, folder).unpivot([], BANDS, "feature", "x")
    r = lambda c, name: F.round(c, 6).alias(name)
    plain = long.groupBy("feature").agg(F.count("x").alias("n"), r(F.avg("x"), "mean"), r(F.stddev_samp("x"), "sd"), r(F.min("x"), "low"), r(F.max("x"), "high"))
    quarters = select.percentiles(long, ["feature"], "x", [0.25, 0.5, 0.75]).select("feature", *[r(F.col("p")[i], name) for i, name in enumerate(("q1", "mid", "q3"))])
    return plain.join(quarters, "feature", "left")


@query(f"WITH {SP}, m AS (SELECT subject, condition, frequency_hz, avg(power) AS p FROM sp WHERE frequency_hz BETWEEN 1 AND 45 AND power > 0 AND power < 1e-9 GROUP BY ALL) SELECT condition, frequency_hz, count(*) AS n_subjects, round(avg(p) * 1e13, 6) AS mean_power FROM m GROUP BY ALL")
def cohort_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = spectrum(spark, folder).where(F.col("frequency_hz").between(1, 45) & (F.col("power") > 0) & (F.col("power") < 1e-9))
    per_subject = rows.groupBy("subject", "condition", "frequency_hz").agg(F.avg("power").alias("p"))
    return per_subject.groupBy("condition", "frequency_hz").agg(F.count(F.lit(1)).alias("n_subjects"), F.round(F.avg("p") * 1e13, 6).alias("mean_power"))


@query(f"""WITH {SP}, t AS (SELECT DISTINCT recording_id, block_id, epoch, absolute_start / 60 AS minute FROM features WHERE absolute_start IS NOT NULL),
b AS (SELECT condition, frequency_hz, power, CASE WHEN minute >= 0 AND minute < 14 THEN 'before' WHEN minute >= 14 AND minute < 44 THEN 'after' WHEN minute >= 44 THEN 'late' END AS phase FROM sp JOIN t USING (recording_id, block_id, epoch) WHERE power > 0 AND NOT isinf(power))
SELECT condition, phase, frequency_hz, count(*) AS n, round(avg(log10(power)), 6) AS mean_log_power FROM b WHERE phase IS NOT NULL GROUP BY ALL""")
def phase_bin_psd(spark: SparkSession, folder: str) -> DataFrame:
    times = table(spark, folder, "features").where("absolute_start IS NOT NULL").select("recording_id", "block_id", "epoch", (F.col("absolute_start") / 60).alias("minute")).distinct()
    phase = pr.window_label(F.col("minute"), {"before": (0.0, 14.0), "after": (14.0, 44.0), "late": (44.0, float("inf"))}, None)
    rows = spectrum(spark, folder).where((F.col("power") > 0) & (F.col("power") != float("inf"))).join(times, ["recording_id", "block_id", "epoch"]).withColumn("phase", phase)
    return rows.where("phase IS NOT NULL").groupBy("condition", "phase", "frequency_hz").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.log10("power")), 6).alias("mean_log_power"))


@query(f"WITH {FT}, s AS (SELECT avg(specparam_exponent) AS m, stddev_samp(specparam_exponent) AS sd FROM f) SELECT recording_id, block_id, epoch, electrode, round((specparam_exponent - m) / sd, 6) AS z FROM f, s WHERE specparam_exponent IS NOT NULL")
def standardise_global(spark: SparkSession, folder: str) -> DataFrame:
    rows = feats(spark, folder).where("specparam_exponent IS NOT NULL")
    stats = rows.agg(F.avg("specparam_exponent").alias("m"), F.stddev_samp("specparam_exponent").alias("sd"))
    m, sd = stats.select("m").scalar(), stats.select("sd").scalar()
    return rows.select("recording_id", "block_id", "epoch", "electrode", F.round((F.col("specparam_exponent") - m) / F.nullif(sd, F.lit(0.0)), 6).alias("z"))


# Pivot, unpivot


@query(f"WITH {H} SELECT recording_id, block_id, epoch, stager, channel_set, upper(substr(name, 6)) AS stage, probability FROM (UNPIVOT (SELECT recording_id, block_id, epoch, stager, channel_set, {', '.join(PROBS)} FROM h) ON {', '.join(PROBS)} INTO NAME name VALUE probability)")
def unpivot_stages(spark: SparkSession, folder: str) -> DataFrame:
    ids = ["recording_id", "block_id", "epoch", "stager", "channel_set"]
    long = hyp(spark, folder).select(*ids, *PROBS).unpivot(ids, PROBS, "name", "probability")
    return long.select(*ids, F.upper(F.regexp_replace("name", "^prob_", "")).alias("stage"), "probability")


@query("SELECT rating_id, subject, CAST(floor(timepoint) AS INTEGER) AS minute, 'intensity' AS scale, intensity AS rating FROM ratings WHERE timepoint IS NOT NULL AND NOT isnan(timepoint) UNION ALL SELECT rating_id, subject, CAST(floor(timepoint) AS INTEGER), 'entity', entity FROM ratings WHERE timepoint IS NOT NULL AND NOT isnan(timepoint)")
def ratings_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ratings").where("timepoint IS NOT NULL AND NOT isnan(timepoint)")
    minute = F.floor("timepoint").cast("string").try_cast("int").alias("minute")
    return rows.select("rating_id", "subject", minute, "intensity", "entity").unpivot(["rating_id", "subject", "minute"], ["intensity", "entity"], "scale", "rating")


_PIVOT = ", ".join(f"""{mean_sql('prob_w', f"experimental_label = '{x}'")} AS {x}""" for x in ("before", "after", "late"))


@query(f"WITH {H} SELECT subject, condition, stager, {_PIVOT} FROM h GROUP BY ALL")
def pivot_labels(spark: SparkSession, folder: str) -> DataFrame:
    return hyp(spark, folder).groupBy("subject", "condition", "stager").pivot("experimental_label", ["before", "after", "late"]).agg(mean_of_millionths("prob_w"))


_TWO = ", ".join(f"""{mean_sql('prob_w', f"stager = '{x}'")} AS {x}_mean, """ f"count(*) FILTER (stager = '{x}')::BIGINT AS {x}_n" for x in ("gssc", "sleepfm", "yasa"))


@query(f"WITH {H} SELECT subject, {_TWO} FROM h GROUP BY 1")
def pivot_two_values(spark: SparkSession, folder: str) -> DataFrame:
    wide = hyp(spark, folder).groupBy("subject").pivot("stager", ["gssc", "sleepfm", "yasa"]).agg(mean_of_millionths("prob_w").alias("mean"), F.count(F.lit(1)).alias("n"))
    return wide.na.fill(0, [f"{s}_n" for s in ("gssc", "sleepfm", "yasa")])


@query("SELECT coalesce(condition, 'none') AS condition, " + ", ".join(f"count(*) FILTER (stage = '{s}')::INTEGER AS n_{s.lower()}" for s in ("W", "N1", "N2", "N3", "R")) + " FROM hypnodensities GROUP BY 1")
def pivot_fill(spark: SparkSession, folder: str) -> DataFrame:
    names = ["W", "N1", "N2", "N3", "R"]
    wide = table(spark, folder, "hypnodensities").withColumn("condition", F.coalesce("condition", F.lit("none"))).groupBy("condition").pivot("stage", names).count().na.fill(0)
    return wide.select("condition", *[F.col(s).cast("int").alias(f"n_{s.lower()}") for s in names])


@query(f"WITH {H}, m AS (SELECT condition, stager, experimental_label, {mean_sql('prob_r')} AS p FROM h GROUP BY ALL) SELECT condition, stager, " + ", ".join(f"max(p) FILTER (experimental_label = '{x}') AS {x}" for x in ("before", "after", "late")) + " FROM m WHERE experimental_label IN ('before', 'after', 'late') GROUP BY ALL")
def pivot_unique_labels(spark: SparkSession, folder: str) -> DataFrame:
    means = hyp(spark, folder).groupBy("condition", "stager", "experimental_label").agg(mean_of_millionths("prob_r").alias("p"))
    return reshape.pivot_unique(means, ["condition", "stager"], "experimental_label", ["before", "after", "late"], "p")


@query(f"WITH {H}, m AS (SELECT condition, experimental_label, stager, printf('%.3f [%d]', round({mean_sql('prob_n2')}, 3), count(*)) AS cell FROM h GROUP BY ALL) SELECT condition, experimental_label, " + ", ".join(f"coalesce(max(cell) FILTER (stager = '{x}'), '') AS {x}" for x in ("gssc", "sleepfm", "yasa")) + " FROM m GROUP BY ALL")
def pivot_formatted_cells(spark: SparkSession, folder: str) -> DataFrame:
    means = hyp(spark, folder).groupBy("condition", "experimental_label", "stager").agg(F.round(mean_of_millionths("prob_n2"), 3).alias("p"), F.count(F.lit(1)).alias("n"))
    return reshape.pivot_cells(means, ["condition", "experimental_label"], "stager", ["gssc", "sleepfm", "yasa"], "%.3f [%d]", F.col("p"), F.col("n"))


@query("SELECT row_id, electrode, bp_rel_delta AS eeg_bp_rel_delta, bp_rel_alpha AS eeg_bp_rel_alpha, specparam_exponent AS eeg_specparam_exponent FROM features")
def columns_by_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.columns_by_suffix(table(spark, folder, "features"), ["row_id", "electrode"], ("_delta", "_alpha", "_exponent"), "eeg_")


@query("SELECT row_id, " + ", ".join(f"{p}" for p in PROBS) + " FROM hypnodensities")
def array_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities that arrive as one array in state order."""
    rows = table(spark, folder, "hypnodensities").select("row_id", F.array(*PROBS).alias("state"))
    return pr.probability_array(rows, "state")


@query("WITH a AS (SELECT row_id, prob_w AS wake, prob_n1 AS S1, prob_n2 AS N2, prob_n3 AS n3, prob_r AS REM FROM hypnodensities) SELECT row_id, wake AS prob_w, S1 AS prob_n1, N2 AS prob_n2, n3 AS prob_n3, REM AS prob_r FROM a")
def aliased_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities under other accepted names and in another order."""
    rows = table(spark, folder, "hypnodensities")
    return pr.probability_columns(rows.select("row_id", F.col("prob_r").alias("REM"), F.col("prob_n3").alias("n3"), F.col("prob_w").alias("wake"), F.col("prob_n1").alias("S1"), F.col("prob_n2").alias("N2")))


_LOG_ODDS = "ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)))"


@query(f"WITH {H} SELECT subject, condition, experimental_label, {each('round(avg(' + _LOG_ODDS + '), 5) AS {c}__logit', ['prob_w', 'prob_n3'])} FROM h GROUP BY ALL")
def logit_means(spark: SparkSession, folder: str) -> DataFrame:
    """Log odds of every epoch, averaged afterwards."""
    return hyp(spark, folder).groupBy("subject", "condition", "experimental_label").agg(*[F.round(F.avg(pr.logit(F.col(p), strict=True)), 5).alias(f"{p}__logit") for p in ("prob_w", "prob_n3")])


@query("SELECT subject, round((CAST('0x' || substr(md5('7/' || subject), 1, 8) AS BIGINT)::DOUBLE / 4294967296 - 0.5) * 0.2, 9) AS jitter FROM subjects")
def subject_jitter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "subjects").select("subject", F.round(windows.seeded_offsets(F.col("subject"), 7, 0.2), 9).alias("jitter"))


_ORDINAL = "CASE condition WHEN 'placebo' THEN 0 WHEN 'DMT' THEN 1 ELSE 2 END AS condition_order, CASE experimental_label WHEN 'before' THEN 0 WHEN 'after' THEN 1 WHEN 'late' THEN 2 ELSE 3 END AS label_order"


@query(f"WITH {H} SELECT condition, experimental_label, {_ORDINAL}, printf('%.3f (%d)', round(avg(prob_w), 3), count(*)) AS cell FROM h GROUP BY condition, experimental_label")
def ordered_cells(spark: SparkSession, folder: str) -> DataFrame:
    order = lambda c, names: F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0))
    rank = lambda c, names: F.when(order(c, names) > 0, order(c, names) - 1).otherwise(len(names)).cast("int")
    cells = hyp(spark, folder).groupBy("condition", "experimental_label").agg(F.format_string("%.3f (%d)", F.round(F.avg("prob_w"), 3), F.count(F.lit(1))).alias("cell"))
    return cells.select("condition", "experimental_label", rank("condition", ["placebo", "DMT"]).alias("condition_order"), rank("experimental_label", ["before", "after", "late"]).alias("label_order"), "cell").orderBy("condition_order", "label_order")


# Selections


_D = "CAST(regexp_extract(session, 'D([0-9]+)', 1) AS INTEGER)"
_PREF = f"CASE WHEN condition <> 'placebo' THEN {_D} = 5 ELSE {_D} = 1 END DESC, CASE WHEN condition <> 'placebo' THEN {_D} END DESC NULLS LAST, recording_id"


@query(f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY subject, condition ORDER BY {_PREF}) AS k FROM recordings) SELECT subject, condition, max(CASE WHEN k = 1 THEN recording_id END) AS selected, coalesce(string_agg(CASE WHEN k > 1 THEN recording_id END, ';' ORDER BY recording_id), '') AS dropped, count(*) AS n_candidates FROM k GROUP BY 1, 2")
def select_prefer(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "recordings").withColumn("d", F.regexp_extract("session", "D([0-9]+)", 1).try_cast("int"))
    return selection.select_preferred(rows, ["subject", "condition"], selection.d5_preference(F.col("condition"), F.col("d"), F.col("recording_id")), "recording_id")


@query("SELECT subject, condition, recording_id AS selected, '' AS dropped, 1::BIGINT AS n_candidates FROM recordings")
def select_all(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recordings").select("subject", "condition", F.col("recording_id").alias("selected"), F.lit("").alias("dropped"), F.lit(1).cast("long").alias("n_candidates"))


@query("WITH l AS (SELECT *, list_position(['D5', 'D2', 'D3'], session) AS r, count(*) OVER (PARTITION BY subject, session) AS n FROM recordings WHERE session IN ('D5', 'D2', 'D3')), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY r) AS k FROM l WHERE n = 1) SELECT subject, session, recording_id FROM k WHERE k = 1")
def session_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return selection.session_fallback(table(spark, folder, "recordings"), ["subject"], "session", ["D5", "D2", "D3"]).select("subject", "session", "recording_id")


_CORR = each("CASE WHEN stddev_pop({c}) * stddev_pop(prob_w) > 0 THEN covar_pop({c}, prob_w) / (stddev_pop({c}) * stddev_pop(prob_w)) END", ["x"])


def _feature_correlations(spark: SparkSession, folder: str) -> DataFrame:
    joined = joins.features_with_probabilities(feats(spark, folder), hyp(spark, folder)).select("prob_w", *BANDS)
    return joined.unpivot(["prob_w"], BANDS, "feature", "x").where("x IS NOT NULL").groupBy("feature").agg(safe_corr("x", "prob_w").alias("correlation"))


_FC = f"{H}, {FT}, j AS (SELECT prob_w, {', '.join(BANDS)} FROM h JOIN f USING (recording_id, block_id, epoch, electrode)), u AS (UNPIVOT j ON {', '.join(BANDS)} INTO NAME feature VALUE x), c AS (SELECT feature, {_CORR} AS correlation FROM u GROUP BY 1)"


@query(f"WITH {_FC} SELECT feature, round(correlation, 6) AS correlation FROM c ORDER BY abs(correlation) DESC, feature LIMIT 3")
def top_n_abs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.top_by_size(_feature_correlations(spark, folder), "correlation", ["feature"], 3), "correlation")


@query(f"WITH {_FC} SELECT arg_max(feature, correlation) AS best_feature, arg_min(feature, correlation) AS worst_feature FROM c")
def argmax_feature(spark: SparkSession, folder: str) -> DataFrame:
    return _feature_correlations(spark, folder).agg(F.max_by("feature", "correlation").alias("best_feature"), F.min_by("feature", "correlation").alias("worst_feature"))


# Sets


@query("SELECT block_id, 'features' AS source, NULL::DOUBLE AS prob_w, bp_rel_alpha FROM features UNION ALL SELECT block_id, 'hypnodensities', prob_w, NULL FROM hypnodensities")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "features").select("block_id", F.lit("features").alias("source"), "bp_rel_alpha")
    b = table(spark, folder, "hypnodensities").select("block_id", F.lit("hypnodensities").alias("source"), "prob_w")
    return a.unionByName(b, allowMissingColumns=True).select("block_id", "source", "prob_w", "bp_rel_alpha")


@query("SELECT DISTINCT block_id FROM features EXCEPT SELECT block_id FROM blocks")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features").select("block_id").subtract(table(spark, folder, "blocks").select("block_id"))


@query("(SELECT recording_id, 'left' AS side FROM (SELECT recording_id FROM recordings EXCEPT SELECT recording_id FROM spectra)) UNION ALL (SELECT recording_id, 'right' FROM (SELECT recording_id FROM spectra EXCEPT SELECT recording_id FROM recordings))")
def set_symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    return checks.symmetric_difference(table(spark, folder, "recordings"), table(spark, folder, "spectra"), "recording_id")


@query("SELECT recording_id, electrode FROM features INTERSECT SELECT recording_id, electrode FROM hypnodensities")
def set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features").select("recording_id", "electrode").intersect(table(spark, folder, "hypnodensities").select("recording_id", "electrode"))


@query("SELECT DISTINCT channel_set, stager FROM hypnodensities")
def distinct_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hypnodensities").select("channel_set", "stager").distinct()


@query("SELECT contrast, row_id FROM (SELECT 'before_to_after' AS contrast, row_id FROM hypnodensities WHERE experimental_label IN ('before', 'after') UNION ALL SELECT 'before_to_late', row_id FROM hypnodensities WHERE experimental_label IN ('before', 'late'))")
def tagged_union(spark: SparkSession, folder: str) -> DataFrame:
    rows, label = table(spark, folder, "hypnodensities"), F.col("experimental_label")
    tags = F.array_compact(F.array(*[F.when(label.isin(*pair), F.lit(name)) for name, pair in changes.CONTRASTS.items()]))
    return rows.select(F.explode(tags).alias("contrast"), "row_id")


@query("SELECT row_id, sha256(recording_id || '/' || block_id || '/' || CAST(epoch AS VARCHAR)) AS digest, recording_id || '/' || block_id AS path, regexp_extract(block_id, '([^_]+)$', 1) AS stem FROM epoch_metadata JOIN (SELECT row_id AS r, epoch_in_block AS epoch FROM epoch_metadata) ON r = row_id")
def sha_inventory(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "recording_id", "block_id", F.col("epoch_in_block").cast("string"))
    return table(spark, folder, "epoch_metadata").select("row_id", F.sha2(path, 256).alias("digest"), F.concat_ws("/", "recording_id", "block_id").alias("path"), F.regexp_extract("block_id", "([^_]+)$", 1).alias("stem"))


@query(f"WITH {FT}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, electrode ORDER BY bp_rel_alpha DESC NULLS LAST, block_id, epoch) AS k FROM f) SELECT recording_id, electrode, block_id, epoch, bp_rel_alpha FROM r WHERE k <= 3")
def top_epochs(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("recording_id", "electrode").orderBy(F.col("bp_rel_alpha").desc_nulls_last(), "block_id", "epoch")
    return feats(spark, folder).withColumn("k", F.row_number().over(w)).where("k <= 3").select("recording_id", "electrode", "block_id", "epoch", "bp_rel_alpha")


_SHARE = " + ".join(f"abs({c})" for c in ("d_w", "d_n1", "d_n2", "d_n3", "d_r"))
_D5 = ["w", "n1", "n2", "n3", "r"]


@query(f"""WITH {H}, m AS (SELECT subject, condition, {each("avg(prob_{c}) FILTER (experimental_label = 'after') - avg(prob_{c}) FILTER (experimental_label = 'before') AS d_{c}", _D5)} FROM h GROUP BY ALL)
SELECT subject, condition, {each('round(CASE WHEN (' + _SHARE + ') > 0 THEN abs(d_{c}) / (' + _SHARE + ') END, 6) AS d_{c}__share', _D5)}, {each('sign(round(d_{c}, 9))::DOUBLE AS d_{c}__sign', _D5)}, round(d_w + d_n1 + d_n2 + d_n3 + d_r, 5) + 0.0 AS closure_error FROM m""")
def composite_shares(spark: SparkSession, folder: str) -> DataFrame:
    wide = changes.within_changes(hyp(spark, folder), PROBS, ["subject", "condition"], contrasts={"before_to_after": ("before", "after")}, deltas=("abs",))
    names = [f"d_{s}" for s in _D5]
    deltas = wide.select("subject", "condition", *[F.col(f"prob_{s}__delta_abs").alias(f"d_{s}") for s in _D5])
    everyone = hyp(spark, folder).select("subject", "condition").distinct()
    full = checks.join_null_safe(everyone, deltas, ["subject", "condition"], "left")
    out = changes.composition(full, names, ["subject", "condition"])
    return out.select("subject", "condition", *[F.round(f"{n}__share", 6).alias(f"{n}__share") for n in names], *[F.signum(F.round(F.col(f"{n}__sign"), 9)).alias(f"{n}__sign") for n in names], (F.round("closure_error", 5) + F.lit(0.0)).alias("closure_error"))


@query(f"WITH {FT}, u AS (UNPIVOT (SELECT electrode, specparam_exponent, {', '.join(BANDS)} FROM f WHERE specparam_exponent IS NOT NULL) ON {', '.join(BANDS)} INTO NAME feature VALUE x) SELECT electrode, feature, count(*) AS n_used, round(covar_pop(x, specparam_exponent) / nullif(stddev_pop(x) * stddev_pop(specparam_exponent), 0), 6) AS correlation FROM u GROUP BY ALL")
def electrode_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of every band share with the exponent, per electrode."""
    long = feats(spark, folder).where("specparam_exponent IS NOT NULL").unpivot(["electrode", "specparam_exponent"], BANDS, "feature", "x").where("x IS NOT NULL")
    return long.groupBy("electrode", "feature").agg(F.count(F.lit(1)).alias("n_used"), F.round(safe_corr("x", "specparam_exponent"), 6).alias("correlation"))


@query(f"""WITH {FT}, u AS (UNPIVOT (SELECT electrode, specparam_exponent, {', '.join(BANDS)} FROM f WHERE specparam_exponent IS NOT NULL AND electrode IS NOT NULL) ON {', '.join(BANDS)} INTO NAME feature VALUE x),
g AS (SELECT electrode, feature, covar_pop(x, specparam_exponent) / nullif(stddev_pop(x) * stddev_pop(specparam_exponent), 0) AS r FROM u GROUP BY ALL),
p AS (SELECT feature, covar_pop(x, specparam_exponent) / nullif(stddev_pop(x) * stddev_pop(specparam_exponent), 0) AS q FROM u GROUP BY ALL)
SELECT electrode, round(covar_pop(r, q) / nullif(stddev_pop(r) * stddev_pop(q), 0), 6) AS similarity, round(avg(abs(r - q)), 6) AS mean_difference, round(max(abs(r - q)), 6) AS max_difference FROM g JOIN p USING (feature) GROUP BY 1""")
def similarity_vectors(spark: SparkSession, folder: str) -> DataFrame:
    long = feats(spark, folder).where("specparam_exponent IS NOT NULL AND electrode IS NOT NULL").select("electrode", "specparam_exponent", *BANDS).unpivot(["electrode", "specparam_exponent"], BANDS, "feature", "x").where("x IS NOT NULL")
    group = long.groupBy("electrode", "feature").agg(safe_corr("x", "specparam_exponent").alias("r"))
    pooled = long.groupBy("feature").agg(safe_corr("x", "specparam_exponent").alias("q"))
    difference = F.abs(F.col("r") - F.col("q"))
    return rounded(group.join(pooled, "feature").groupBy("electrode").agg(safe_corr("r", "q").alias("similarity"), F.avg(difference).alias("mean_difference"), F.max(difference).alias("max_difference")), "similarity", "mean_difference", "max_difference")


@query(f"""WITH {FT}, u AS (UNPIVOT (SELECT subject, {', '.join(FEATURES)} FROM f) ON {', '.join(FEATURES)} INTO NAME feature VALUE x), s AS (SELECT feature, subject FROM u WHERE NOT isinf(x) GROUP BY ALL HAVING avg(x) > 0.2)
SELECT CASE WHEN feature LIKE 'bp_%' THEN 'band power' WHEN feature LIKE 'specparam_%' THEN 'aperiodic' ELSE 'staging' END AS category, count(*) AS n_significant FROM s GROUP BY 1""")
def category_composition(spark: SparkSession, folder: str) -> DataFrame:
    long = feats(spark, folder).select("subject", *FEATURES).unpivot(["subject"], FEATURES, "feature", "x").where(F.col("x").isNotNull() & (F.abs("x") != float("inf")))
    kept = long.groupBy("feature", "subject").agg(F.avg("x").alias("m")).where("m > 0.2")
    kinds = F.create_map(*[F.lit(v) for f in FEATURES for v in (f, "band power" if f.startswith("bp_") else "aperiodic" if f.startswith("specparam_") else "staging")])
    return kept.groupBy(kinds[F.col("feature")].alias("category")).agg(F.count(F.lit(1)).alias("n_significant"))


@query(f"WITH {H}, a AS (SELECT subject, condition, experimental_label, stager, recording_id, block_id, epoch, {each('avg({c}) AS {c}', PROBS)} FROM h WHERE electrode IS NOT NULL GROUP BY ALL) SELECT recording_id, block_id, epoch, stager, {each('round({c}, 10) AS {c}', PROBS)} FROM a")
def electrode_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = hyp(spark, folder).where("electrode IS NOT NULL")
    means = rows.groupBy("subject", "condition", "experimental_label", "stager", "recording_id", "block_id", "epoch").agg(*[F.avg(p).alias(p) for p in PROBS])
    return rounded(means.select("recording_id", "block_id", "epoch", "stager", *PROBS), *PROBS, digits=10)


@query(f"""WITH {H}, {_RATED}, b AS (SELECT subject, stager, avg(prob_w) AS base FROM h WHERE experimental_label = 'before' GROUP BY ALL),
m AS (SELECT o.rating_id, r.subject, o.stager, sum(o.prob_w * o.overlap) / sum(o.overlap) AS prob_w FROM o JOIN r USING (rating_id) GROUP BY ALL)
SELECT rating_id, stager, round(prob_w - base, 11) AS prob_w FROM m JOIN b USING (subject, stager)""")
def overlap_minus_baseline(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _rated(spark, folder)[1]
    means = pairs.groupBy("rating_id", "subject", "stager").agg((F.sum(F.col("prob_w") * F.col("overlap")) / F.sum("overlap")).alias("prob_w"))
    base = hyp(spark, folder).where("experimental_label = 'before'").groupBy("subject", "stager").agg(F.avg("prob_w").alias("prob_w"))
    return rounded(joins.subtract_baseline(means, base, ["subject", "stager"], ["prob_w"]).select("rating_id", "stager", "prob_w"), "prob_w", digits=11)


@query("""WITH m AS (SELECT recording_id, block_id, epoch_in_block AS epoch, min(absolute_start) AS epoch_start, bool_or(break_before) AS breaks FROM epoch_metadata GROUP BY ALL)
SELECT h.row_id, m.epoch_start, m.breaks FROM hypnodensities h LEFT JOIN m USING (recording_id, block_id, epoch)""")
def attach_metadata(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "epoch_metadata").groupBy("recording_id", "block_id", F.col("epoch_in_block").alias("epoch")).agg(F.min("absolute_start").alias("epoch_start"), F.bool_or("break_before").alias("breaks"))
    staged = table(spark, folder, "hypnodensities").select("row_id", "recording_id", "block_id", "epoch")
    return joins.attach_metadata(staged, meta, ["recording_id", "block_id", "epoch"]).select("row_id", "epoch_start", "breaks")


@query(f"""WITH {FT}, b AS (SELECT DISTINCT recording_id, block_id, epoch, electrode FROM f), s AS (SELECT recording_id, block_id, epoch, electrode, count(*) AS n_frequencies, max(power) FILTER (power > 0 AND NOT isinf(power)) AS top_power FROM spectra WHERE power IS NOT NULL AND NOT isnan(power) GROUP BY ALL)
SELECT recording_id, block_id, epoch, electrode, bp_rel_alpha, specparam_exponent, n_frequencies, top_power FROM b LEFT JOIN f USING (recording_id, block_id, epoch, electrode) LEFT JOIN s USING (recording_id, block_id, epoch, electrode)""")
def join_analyses(spark: SparkSession, folder: str) -> DataFrame:
    base = feats(spark, folder).select(*joins.EPOCH_KEYS).distinct()
    power = F.when((F.col("power") > 0) & (F.col("power") != float("inf")), F.col("power"))
    spectral = clean_table(spark, folder, "spectra").where("power IS NOT NULL").groupBy(*joins.EPOCH_KEYS).agg(F.count(F.lit(1)).alias("n_frequencies"), F.max(power).alias("top_power"))
    return joins.join_analyses(base, [feats(spark, folder).select(*joins.EPOCH_KEYS, "bp_rel_alpha", "specparam_exponent"), spectral])


@query("WITH r AS (SELECT DISTINCT recording_id, block_id, run_id, start_time, signal FROM continuous_runs WHERE signal IS NOT NULL) SELECT recording_id, block_id, sum(len(signal))::INTEGER AS n_values, count(*) AS n_runs, string_agg(run_id, ';' ORDER BY start_time, run_id) AS runs FROM r GROUP BY ALL")
def block_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of a block's runs in order of time, as one array (a block is bounded by its recording)."""
    rows = table(spark, folder, "continuous_runs").where("signal IS NOT NULL").select("recording_id", "block_id", "run_id", "start_time", "signal").distinct()
    joined = rows.groupBy("recording_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "run_id", "signal"))).alias("r"))
    whole = joined.withColumn("s", F.flatten(F.transform("r", lambda x: x["signal"])))
    return whole.select("recording_id", "block_id", F.size("s").alias("n_values"), F.size("r").cast("long").alias("n_runs"), F.array_join(F.transform("r", lambda x: x["run_id"]), ";").alias("runs"))


@query("SELECT stage, min(row_id) AS first_position FROM hypnodensities GROUP BY 1")
def first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    return checks.first_appearance(table(spark, folder, "hypnodensities"), "stage", "row_id")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n_events FROM events GROUP BY ALL")
def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"].alias("k")
    return table(spark, folder, "events").groupBy("event_type", k).agg(F.count(F.lit(1)).alias("n_events"))

"""Queries of the statistical operators: changes, effects, tests, correlations, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.functions import probability as pr
from epochloom.operators import changes, joins, mixed, ranks
from epochloom.plans.common import BANDS, FT, H, PROBS, each, feats, hyp, mean_of_millionths, mean_sql, query
from epochloom.sources.tables import table

ENTITY = ["subject", "condition", "electrode", "stager"]
_ENT = ", ".join(ENTITY)
_PAIR = ["subject", "electrode", "stager", "contrast"]


def _single(spark: SparkSession, folder: str) -> DataFrame:
    return hyp(spark, folder).where("electrode IS NOT NULL")


def _changes_sql(values: list[str], source: str, rel_eps: str = "1e-6") -> str:
    """CTE c: entity, contrast and per value baseline, follow-up and changes."""
    per = ", ".join(f"avg({v}) FILTER (experimental_label = '{x}') AS {v}_{x}" for v in values for x in ("before", "after", "late"))
    n = ", ".join(f"count(*) FILTER (experimental_label = '{x}') AS n_{x}" for x in ("before", "after", "late"))
    one = lambda v, f: (
        f"{v}_before AS {v}__baseline, {v}_{f} AS {v}__followup, {v}_{f} - {v}_before AS {v}__delta_abs, "
        f"({v}_{f} - {v}_before) / (CASE WHEN {v}_before < 0 THEN -1 ELSE 1 END * greatest(abs({v}_before), {rel_eps})) AS {v}__delta_rel"
    )
    part = lambda f: f"SELECT {_ENT}, 'before_to_{f}' AS contrast, {', '.join(one(v, f) for v in values)} FROM w WHERE n_before > 0 AND n_{f} > 0"
    return f"w AS (SELECT {_ENT}, {per}, {n} FROM {source} GROUP BY ALL), c AS ({part('after')} UNION ALL {part('late')})"


_MONO = "m AS (SELECT * FROM h WHERE electrode IS NOT NULL)"
_C = f"{H}, {_MONO}, {_changes_sql(PROBS, 'm')}"
_LOGIT = "ln(least(greatest({x}, 1e-6), 1 - 1e-6) / (1 - least(greatest({x}, 1e-6), 1 - 1e-6)))"


@query(f"WITH {_C} SELECT {_ENT}, contrast, {each('round({c}__baseline, 12) AS {c}__baseline, round({c}__followup, 12) AS {c}__followup, round({c}__delta_abs, 12) AS {c}__delta_abs, round({c}__delta_rel, 5) AS {c}__delta_rel, round(' + _LOGIT.format(x='{c}__followup') + ' - ' + _LOGIT.format(x='{c}__baseline') + ', 5) AS {c}__delta_logit', ['prob_w', 'prob_r'])} FROM c")
def within_changes(spark: SparkSession, folder: str) -> DataFrame:
    wide = changes.within_changes(_single(spark, folder), ["prob_w", "prob_r"], ENTITY, deltas=("abs", "rel", "logit"))
    digits = {"baseline": 12, "followup": 12, "delta_abs": 12, "delta_rel": 5, "delta_logit": 5}
    return wide.withColumns({f"{v}__{k}": F.round(f"{v}__{k}", d) for v in ("prob_w", "prob_r") for k, d in digits.items()})


def _effects(spark: SparkSession, folder: str, values: list[str]) -> DataFrame:
    return changes.treatment_effects(changes.within_changes(_single(spark, folder), values, ENTITY), values, _PAIR)


_EFF = f"""{_C}, e AS (SELECT t.subject, t.electrode, t.stager, t.contrast, d.delta_type, 'DMT_minus_placebo' AS effect_direction,
 {each("CASE d.delta_type WHEN 'abs' THEN t.{c}__delta_abs - k.{c}__delta_abs ELSE t.{c}__delta_rel - k.{c}__delta_rel END AS {c}__effect", PROBS)}
 FROM c t JOIN c k ON t.subject = k.subject AND t.electrode = k.electrode AND t.stager = k.stager AND t.contrast = k.contrast AND t.condition = 'DMT' AND k.condition = 'placebo', (VALUES ('abs'), ('rel')) d(delta_type))"""


@query(f"WITH {_EFF} SELECT subject, electrode, stager, contrast, delta_type, effect_direction, {each('round({c}__effect, 5) AS {c}__effect', PROBS)} FROM e")
def treatment_effects(spark: SparkSession, folder: str) -> DataFrame:
    return _effects(spark, folder, PROBS).withColumns({f"{p}__effect": F.round(f"{p}__effect", 5) for p in PROBS})


@query(f"WITH {_EFF} SELECT stager, contrast, delta_type, count(*) AS n_pairs, {each('round(avg({c}__effect), 5) AS {c}__mean_effect, count(*) FILTER ({c}__effect > 1e-9) AS {c}__n_up', PROBS)} FROM e GROUP BY ALL")
def effect_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means per label, changes, paired effects and their summary in one lazy plan."""
    e = _effects(spark, folder, PROBS)
    return e.groupBy("stager", "contrast", "delta_type").agg(F.count(F.lit(1)).alias("n_pairs"), *[a for p in PROBS for a in (F.round(F.avg(f"{p}__effect"), 5).alias(f"{p}__mean_effect"), F.count(F.when(F.col(f"{p}__effect") > 1e-9, 1)).alias(f"{p}__n_up"))])


_D = "w AS (SELECT " + _ENT + ", " + ", ".join(f"count(prob_w) FILTER (experimental_label = '{x}') AS n_{x}, avg(prob_w) FILTER (experimental_label = '{x}') AS m_{x}, var_samp(prob_w) FILTER (experimental_label = '{x}') AS v_{x}" for x in ("before", "after", "late")) + " FROM m GROUP BY ALL)"
_DP = "sqrt(((n_before - 1) * v_before + (n_{f} - 1) * v_{f}) / nullif(n_before + n_{f} - 2, 0))"
_DS = lambda f: f"SELECT {_ENT}, 'before_to_{f}' AS contrast, round(CASE WHEN n_before >= 2 AND n_{f} >= 2 AND {_DP.format(f=f)} > 0 THEN (m_{f} - m_before) / {_DP.format(f=f)} END, 5) AS prob_w__cohen_d FROM w"


@query(f"WITH {H}, {_MONO}, {_D} {_DS('after')} UNION ALL {_DS('late')}")
def cohen_d(spark: SparkSession, folder: str) -> DataFrame:
    return changes.cohen_d(_single(spark, folder), ["prob_w"], ENTITY).withColumn("prob_w__cohen_d", F.round("prob_w__cohen_d", 5))


_RANKED = f"""{H}, s AS (SELECT stager, experimental_label, subject, {each("avg({c}) FILTER (condition = 'DMT') AS {c}_t, avg({c}) FILTER (condition = 'placebo') AS {c}_c", PROBS)} FROM h WHERE condition IN ('DMT', 'placebo') GROUP BY ALL),
l AS ({each("SELECT stager, experimental_label, '{c}' AS metric, {c}_t AS t, {c}_c AS c FROM s", PROBS, " UNION ALL ")}),
p AS (SELECT *, t - c AS d, abs(t - c) > 1e-12 AS nz, round(abs(t - c), 12) AS size FROM l WHERE t IS NOT NULL AND c IS NOT NULL),
r AS (SELECT *, CASE WHEN nz THEN rank() OVER (PARTITION BY stager, experimental_label, metric, nz ORDER BY size) + (count(*) OVER (PARTITION BY stager, experimental_label, metric, nz, size) - 1) / 2.0 END AS rk FROM p),
a AS (SELECT stager, experimental_label, metric, count(*) AS n_pairs, count(*) FILTER (nz) AS n_nonzero_pairs, avg(t) AS mt, avg(c) AS mc, median(d) AS md, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS plus, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS minus, sum(rk) AS total FROM r GROUP BY ALL)"""


@query(f"WITH {_RANKED} SELECT stager, experimental_label, metric, n_pairs, n_nonzero_pairs, round(mt, 12) AS mean_treatment, round(mc, 12) AS mean_control, round(md, 12) AS median_difference, CASE WHEN total > 0 THEN least(plus, minus) END AS statistic, round((plus - minus) / nullif(plus + minus, 0), 7) AS rank_biserial FROM a")
def paired_wilcoxon_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = ranks.paired_signed_rank(hyp(spark, folder), PROBS, ["stager", "experimental_label"], with_p=False)
    return out.withColumns({c: F.round(c, 12) for c in ("mean_treatment", "mean_control", "median_difference")} | {"rank_biserial": F.round("rank_biserial", 7)})


@query()
def paired_wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    """With p-values and their adjustment over the whole output."""
    tests = ranks.paired_signed_rank(hyp(spark, folder), PROBS, ["stager", "experimental_label"])
    return ranks.adjust_pvalues(tests, "p_value", [], out="p_fdr_bh")


_P = f"{H}, p AS (SELECT condition, stager, electrode, {mean_sql('prob_n1')} AS p FROM h WHERE electrode IS NOT NULL GROUP BY ALL)"


def _pvalues(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).groupBy("condition", "stager", "electrode").agg(mean_of_millionths("prob_n1").alias("p"))


@query(f"WITH {_P}, k AS (SELECT *, p * count(p) OVER (PARTITION BY stager) / row_number() OVER (PARTITION BY stager ORDER BY p) AS raw FROM p) SELECT condition, stager, electrode, p, least(min(raw) OVER (PARTITION BY stager ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING), 1.0) AS p_adjusted FROM k")
def bh_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.adjust_pvalues(_pvalues(spark, folder), "p", ["stager"])


@query(f"WITH {_P} SELECT condition, stager, electrode, p, least(p * count(p) OVER (), 1.0) AS p_adjusted FROM p")
def bonferroni_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.adjust_pvalues(_pvalues(spark, folder), "p", [], "bonferroni")


@query(f"WITH {_P} SELECT condition, stager, electrode, CASE WHEN p < 0.05 THEN '***' WHEN p < 0.1 THEN '**' WHEN p < 0.15 THEN '*' ELSE '' END AS stars, round(-log10(greatest(p, 1e-300)), 7) AS minus_log10_p FROM p")
def significance_stars(spark: SparkSession, folder: str) -> DataFrame:
    return _pvalues(spark, folder).select("condition", "stager", "electrode", pr.stars(F.col("p"), (0.05, 0.1, 0.15)).alias("stars"), F.round(pr.minus_log10(F.col("p")), 7).alias("minus_log10_p"))


_J = f"{H}, {FT}, j AS (SELECT stager, {', '.join(PROBS)}, {', '.join(BANDS)} FROM h JOIN f USING (recording_id, block_id, epoch, electrode))"
_LONG = f"{_J}, l AS (SELECT stager, a.l AS \"left\", a.x, b.r AS \"right\", b.y FROM j, LATERAL (VALUES {each(chr(40) + chr(39) + '{c}' + chr(39) + ', {c})', PROBS)}) a(l, x), LATERAL (VALUES {each(chr(40) + chr(39) + '{c}' + chr(39) + ', {c})', BANDS)}) b(r, y))"


def _corr_sql(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({both}) * stddev_pop({y}) FILTER ({both}), 0)"


def _matrix(spark: SparkSession, folder: str, method: str) -> DataFrame:
    joined = joins.features_with_probabilities(feats(spark, folder), hyp(spark, folder))
    paired = joined.join(feats(spark, folder).select(*joins.EPOCH_KEYS), joins.EPOCH_KEYS, "left_semi")
    return ranks.correlation_matrix(paired, PROBS, BANDS, ["stager"], (method,)).withColumn("correlation", F.round("correlation", 6))


@query(f"WITH {_LONG} SELECT stager, \"left\", \"right\", count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_used, count(*) FILTER (x IS NULL OR y IS NULL) AS n_missing, CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 30 THEN round({_corr_sql('x', 'y')}, 6) END AS correlation, 'pearson' AS method, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 30 AS enough FROM l GROUP BY ALL")
def stage_feature_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder, "pearson")


@query(f"""WITH {_LONG}, k AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS ok FROM l),
r AS (SELECT stager, "left", "right", ok, CASE WHEN ok THEN rank() OVER (PARTITION BY stager, "left", "right", ok ORDER BY x) + (count(*) OVER (PARTITION BY stager, "left", "right", ok, x) - 1) / 2.0 END AS rx, CASE WHEN ok THEN rank() OVER (PARTITION BY stager, "left", "right", ok ORDER BY y) + (count(*) OVER (PARTITION BY stager, "left", "right", ok, y) - 1) / 2.0 END AS ry FROM k)
SELECT stager, "left", "right", count(*) FILTER (ok) AS n_used, count(*) FILTER (NOT ok) AS n_missing, CASE WHEN count(*) FILTER (ok) >= 30 THEN round({_corr_sql('rx', 'ry')}, 6) END AS correlation, 'spearman' AS method, count(*) FILTER (ok) >= 30 AS enough FROM r GROUP BY ALL""")
def stage_feature_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return _matrix(spark, folder, "spearman")


_AL = "recording_id, block_id, epoch, channel_set"


@query(f"WITH {H}, x AS (SELECT a.stager AS stager_a, b.stager AS stager_b, {each('a.{c} AS {c}_a, b.{c} AS {c}_b', PROBS)} FROM h a JOIN h b USING ({_AL}) WHERE a.stager < b.stager) " + each("SELECT stager_a, stager_b, '{c}' AS metric, count(*) AS n_epochs, round(covar_pop({c}_a, {c}_b) / nullif(stddev_pop({c}_a) * stddev_pop({c}_b), 0), 6) AS correlation FROM x GROUP BY ALL", PROBS, " UNION ALL "))
def stager_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.stager_agreement(hyp(spark, folder), PROBS, ["recording_id", "block_id", "epoch", "channel_set"], [], with_p=False).withColumn("correlation", F.round("correlation", 6))


@query()
def stager_pairs_p(spark: SparkSession, folder: str) -> DataFrame:
    """Per condition, with entropy and p-values."""
    rows = hyp(spark, folder).withColumn("entropy", pr.entropy(PROBS))
    return ranks.adjust_pvalues(ranks.stager_agreement(rows, [*PROBS, "entropy"], ["recording_id", "block_id", "epoch", "channel_set"], ["condition"]), "p_value", [])


_RT = "r AS (SELECT upper(trim(subject)) AS subject, session, timepoint, intensity FROM ratings WHERE subject IS NOT NULL AND timepoint IS NOT NULL AND NOT isnan(timepoint) AND intensity IS NOT NULL AND NOT isnan(intensity))"


@query(f"WITH {_RT} SELECT subject, count(*) AS n, round(regr_slope(intensity, timepoint), 5) AS slope, round(regr_intercept(intensity, timepoint), 5) AS intercept FROM r GROUP BY 1 HAVING count(DISTINCT timepoint) >= 3")
def trend_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ratings").where("subject IS NOT NULL AND timepoint IS NOT NULL AND NOT isnan(timepoint) AND intensity IS NOT NULL AND NOT isnan(intensity)")
    lines = rows.groupBy(F.upper(F.trim("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("intensity", "timepoint"), 5).alias("slope"), F.round(F.regr_intercept("intensity", "timepoint"), 5).alias("intercept"), F.countDistinct("timepoint").alias("k"))
    return lines.where("k >= 3").drop("k")


_CS = f"{FT}, g AS (SELECT condition, regr_slope(specparam_exponent, bp_rel_delta) AS b FROM f GROUP BY 1), s AS (SELECT condition, stddev_samp(specparam_exponent) AS sy, stddev_samp(bp_rel_delta) AS sx FROM f WHERE specparam_exponent IS NOT NULL AND bp_rel_delta IS NOT NULL GROUP BY 1)"


@query(f"WITH {_CS} SELECT g.condition, round(b, 5) AS slope, round(b * sx / nullif(sy, 0), 5) AS standardised_slope FROM g JOIN s ON g.condition IS NOT DISTINCT FROM s.condition")
def coef_rescale(spark: SparkSession, folder: str) -> DataFrame:
    rows = feats(spark, folder).where("specparam_exponent IS NOT NULL AND bp_rel_delta IS NOT NULL")
    g = rows.groupBy("condition").agg(F.regr_slope("specparam_exponent", "bp_rel_delta").alias("b"), F.stddev_samp("specparam_exponent").alias("sy"), F.stddev_samp("bp_rel_delta").alias("sx"))
    return g.select("condition", F.round("b", 5).alias("slope"), F.round(F.col("b") * F.col("sx") / F.nullif("sy", F.lit(0.0)), 5).alias("standardised_slope"))


def _design(rows: DataFrame) -> dict:
    treated = (F.col("condition") == "DMT").cast("double")
    after = (F.col("experimental_label") == "after").cast("double")
    return {"treated": treated, "after": after, "treated:after": treated * after}


def _did(spark: SparkSession, folder: str) -> DataFrame:
    return _single(spark, folder).where("condition IN ('DMT', 'placebo') AND experimental_label IN ('before', 'after')")


@query()
def mixed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Difference-in-differences models of every state per stager: subject intercepts, electrodes within."""
    rows = _did(spark, folder)
    fits = mixed.fit_mixed_models(rows, PROBS, _design(rows), "subject", "electrode", ("stager",))
    return ranks.adjust_pvalues(fits, "p_value", ["term"], out="p_fdr_bh")


@query()
def mixed_likelihood_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction against no interaction, per stager and state."""
    rows = _did(spark, folder)
    full = _design(rows)
    small = {k: v for k, v in full.items() if ":" not in k}
    fit = lambda d: mixed.fit_mixed_models(rows, PROBS, d, "subject", "electrode", ("stager",))
    return mixed.likelihood_ratio(fit(small), fit(full), ["stager", "outcome"], 1)


@query()
def feature_mixed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Feature shares against state probability, subject intercepts, electrodes within."""
    rows = joins.features_with_probabilities(feats(spark, folder), hyp(spark, folder))
    return mixed.fit_mixed_models(rows, BANDS, {"prob_w": F.col("prob_w")}, "subject", "electrode", ("stager",))


@query()
def delta_feature_models(spark: SparkSession, folder: str) -> DataFrame:
    """Does the treated minus control difference of a feature go with that of a state, and does it do so otherwise after than before?

    One model per stager, feature and state over subjects, electrodes and phases; the interactions' p-values are
    adjusted per contrast.
    """
    rows = joins.features_with_probabilities(feats(spark, folder), hyp(spark, folder)).where("condition IN ('DMT', 'placebo') AND experimental_label IN ('before', 'after', 'late')")
    states = [p for p in PROBS if p != "prob_w"]
    mean = lambda c, side: F.avg(F.when(F.col("condition") == side, F.col(c)))
    delta = rows.groupBy("stager", "subject", "electrode", F.col("experimental_label").alias("phase")).agg(*[(mean(c, "DMT") - mean(c, "placebo")).alias(c) for c in (*BANDS, *states)])
    long = delta.unpivot(["stager", "subject", "electrode", "phase", *states], BANDS, "feature", "x").where("x IS NOT NULL")
    after, late = ((F.col("phase") == p).cast("double") for p in ("after", "late"))
    fixed = {"x": F.col("x"), "after": after, "late": late, "x:after": F.col("x") * after, "x:late": F.col("x") * late}
    fits = mixed.fit_mixed_models(long, states, fixed, "subject", "electrode", ("stager", "feature")).where("term IS NULL OR term LIKE 'x:%'")
    return ranks.adjust_pvalues(fits.withColumn("contrast", F.substring("term", 3, 9)), "p_value", ["contrast"], out="q_fdr")


@query()
def rating_mixed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings against their time point with subject intercepts only."""
    rows = table(spark, folder, "ratings").withColumn("subject", F.upper(F.trim("subject")))
    return mixed.fit_mixed_models(rows, ["intensity", "entity"], {"timepoint": F.col("timepoint")}, "subject", None, ())


@query()
def rating_time_splines(spark: SparkSession, folder: str) -> DataFrame:
    """Does a cubic spline in time explain ratings better than a straight line, subject intercepts in both?"""
    rows = table(spark, folder, "ratings").withColumn("subject", F.upper(F.trim("subject")))
    curve = mixed.spline_terms("t", F.col("timepoint"), [10.0, 20.0, 30.0])
    fit = lambda fixed: mixed.fit_mixed_models(rows, ["intensity", "entity"], fixed, "subject", None, ())
    return mixed.likelihood_ratio(fit({"t": F.col("timepoint")}), fit(curve), ["outcome"], len(curve) - 1)

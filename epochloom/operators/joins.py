"""Joins of the analysis: features with probabilities, intervals with intervals, labels by lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.operators.checks import join_null_safe, require_unique

EPOCH_KEYS = ["recording_id", "block_id", "epoch", "electrode"]


def features_with_probabilities(features: DataFrame, probabilities: DataFrame, keys: list[str] = EPOCH_KEYS, strict: bool = False) -> DataFrame:
    """Left join of single-electrode probability rows with the features of their epoch and electrode.

    Rows without an electrode (several channels at once) are left out; only feature columns that the
    left side lacks are added. ``strict`` raises on repeated feature keys and on rows without features.
    """
    single = probabilities.where(F.col("electrode").isNotNull())
    added = features.select(*keys, *[c for c in features.columns if c not in probabilities.columns])
    if strict:
        require_unique(added, keys, "features")
        lost = single.join(added, keys, "left_anti").select(*keys).limit(5).collect()
        if lost:
            raise ValueError(f"epochs without features: {[tuple(r) for r in lost]}")
    return single.join(added, keys, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows whose key the right side lacks (NULL keys match NULL)."""
    return join_null_safe(left, right.select(*keys).distinct(), keys, "left_anti")


def overlap_pairs(left: DataFrame, right: DataFrame, key: list[str], bin_width: float) -> DataFrame:
    """Pairs of left and right intervals of one key that share more than a point.

    Both sides have the key, ``start`` and ``end`` (left: l_start, l_end; right: r_start, r_end) and
    any columns with distinct names. Adds overlap = min(ends) - max(starts) > 0. Intervals with a missing
    or infinite end are none. An interval lies in one or two bins of its own level, whose bins are the
    least power of two of ``bin_width`` that is no shorter; it is listed there and at the coarser levels
    that the other side has under its key, so that even an absurdly long one has few entries. Two
    intervals meet at the coarser of their levels, in the bin where their overlap starts: no pair
    comes out twice, and the work per key is bounded by what lies in one bin.
    """
    finite = lambda a, b: (F.col(a) > float("-inf")) & (F.col(b) < float("inf")) & (F.col(b) >= F.col(a))
    level = lambda a, b: F.ceil(F.log2(F.greatest((F.col(b) - F.col(a)) / bin_width, F.lit(1.0)))).cast("int")
    a = left.where(finite("l_start", "l_end")).withColumn("_la", level("l_start", "l_end"))
    b = right.where(finite("r_start", "r_end")).withColumn("_lb", level("r_start", "r_end"))

    def listed(rows: DataFrame, own: str, other: DataFrame, others: str, start: str, end: str) -> DataFrame:
        levels = other.groupBy(*key).agg(F.collect_set(others).alias("_levels"))
        at = rows.join(levels, key).withColumn("_level", F.explode(F.array_union(F.array(own), F.filter("_levels", lambda x: x > F.col(own))))).drop("_levels")
        width = F.lit(bin_width) * F.pow(F.lit(2.0), F.col("_level"))
        return at.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))

    pairs = listed(a, "_la", b, "_lb", "l_start", "l_end").join(listed(b, "_lb", a, "_la", "r_start", "r_end"), [*key, "_level", "_bin"])
    start, width = F.greatest("l_start", "r_start"), F.lit(bin_width) * F.pow(F.lit(2.0), F.col("_level"))
    met = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_level") == F.greatest("_la", "_lb")) & (F.floor(start / width) == F.col("_bin"))
    return pairs.where(met).withColumn("overlap", F.least("l_end", "r_end") - start).where("overlap > 0").drop("_bin", "_level", "_la", "_lb")


def relabel_set(labels: Column, mapping: Column, separator: str = "+") -> Column:
    """Replace every member of a separated list by the map's value, members without one stay."""
    return F.array_join(F.transform(F.split(labels, rf"\{separator}"), lambda x: F.coalesce(mapping[x], x)), separator)


def epoch_grid(epochs: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Every epoch of a recording with every electrode used in that recording (bounded per recording)."""
    return epochs.join(electrodes, "recording_id")


def montage(electrodes: DataFrame, label: str = "el_10_20", excluded: str = "Iz") -> DataFrame:
    """Electrodes of the analysis montage: labels ending in z, 1 or 2, or starting with PO, but not Iz."""
    c = F.col(label)
    return electrodes.where((c.endswith("z") | c.endswith("1") | c.endswith("2") | c.startswith("PO")) & (c != excluded))


def attach_metadata(staged: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of staging rows with the metadata of their epoch (one row per key)."""
    return join_null_safe(staged, epochs, keys, "left")


def join_analyses(base: DataFrame, tables: list[DataFrame], keys: list[str] = EPOCH_KEYS) -> DataFrame:
    """Chain of left joins that adds each analysis' columns to the base grid, one row per key."""
    for df in tables:
        base = base.join(df, keys, "left")
    return base


def subtract_baseline(values: DataFrame, baseline: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values minus the baseline of their key; rows without a baseline are left out."""
    renamed = baseline.select(*keys, *[F.col(c).alias(f"_base_{c}") for c in columns])
    joined = values.join(renamed, keys)
    return joined.withColumns({c: F.col(c) - F.col(f"_base_{c}") for c in columns}).drop(*[f"_base_{c}" for c in columns])

"""Baseline-to-follow-up changes, effect sizes and treatment effects.

Each is one aggregation with a condition per label instead of joins of a table with itself: the
entity's rows are shuffled once, partially aggregated, whatever the number of contrasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.functions.probability import logit, relative_change

CONTRASTS = {"before_to_after": ("before", "after"), "before_to_late": ("before", "late")}


def _missing_is_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _labels(contrasts: dict[str, tuple[str, str]]) -> list[str]:
    return list(dict.fromkeys(x for pair in contrasts.values() for x in pair))


def within_changes(
    df: DataFrame, values: list[str], entity: list[str], label: str = "experimental_label", contrasts: dict[str, tuple[str, str]] = CONTRASTS, deltas: tuple[str, ...] = ("abs", "rel"), epsilon: float = 1e-6,
) -> DataFrame:
    """Per entity and contrast: baseline and follow-up means of each value and their changes.

    Entities need rows under both labels. NULL entity columns form entities; NULL and NaN values are
    skipped by the means, and a mean of none leaves NULL changes. Changes: 'abs' difference, 'rel' over
    the signed baseline of size ``epsilon`` at least, 'logit' difference of log odds.
    """
    labels = _labels(contrasts)
    lab = F.col(label)
    rows = df.where(lab.isin(labels)).groupBy(*entity).agg(
        *[F.count(F.when(lab == x, 1)).alias(f"n__{x}") for x in labels],
        *[F.avg(F.when(lab == x, _missing_is_null(F.col(v)))).alias(f"{v}__{x}") for v in values for x in labels],
    )
    kinds = {"abs": lambda b, f: f - b, "rel": lambda b, f: relative_change(b, f, epsilon), "logit": lambda b, f: logit(f, epsilon) - logit(b, epsilon)}

    def one(name: str, base: str, follow: str) -> DataFrame:
        out: list[Column] = []
        for v in values:
            b, f = F.col(f"{v}__{base}"), F.col(f"{v}__{follow}")
            out += [b.alias(f"{v}__baseline"), f.alias(f"{v}__followup"), *[kinds[d](b, f).alias(f"{v}__delta_{d}") for d in deltas]]
        return F.when((F.col(f"n__{base}") > 0) & (F.col(f"n__{follow}") > 0), F.struct(F.lit(name).alias("contrast"), *out))

    return rows.select(*entity, F.explode(F.array_compact(F.array(*[one(n, b, f) for n, (b, f) in contrasts.items()]))).alias("c")).select(*entity, "c.*")


def treatment_effects(
    changes: DataFrame, values: list[str], pairing: list[str], deltas: tuple[str, ...] = ("abs", "rel"), condition: str = "condition", treatment: str = "DMT", control: str = "placebo",
) -> DataFrame:
    """Treatment minus control change per pairing key, one row per kind of change.

    Keys need a row under both conditions; ``changes`` holds one row per key and condition.
    """
    cond = F.col(condition)
    pick = lambda c, which: F.max(F.when(cond == which, F.col(c)))
    wide = changes.where(cond.isin(treatment, control)).groupBy(*pairing).agg(
        F.count(F.when(cond == treatment, 1)).alias("n_t"), F.count(F.when(cond == control, 1)).alias("n_c"),
        *[(pick(f"{v}__delta_{d}", treatment) - pick(f"{v}__delta_{d}", control)).alias(f"{v}__{d}") for v in values for d in deltas],
    ).where("n_t > 0 AND n_c > 0")
    per_kind = [F.struct(F.lit(d).alias("delta_type"), F.lit(f"{treatment}_minus_{control}").alias("effect_direction"), *[F.col(f"{v}__{d}").alias(f"{v}__effect") for v in values]) for d in deltas]
    return wide.select(*pairing, F.explode(F.array(*per_kind)).alias("e")).select(*pairing, "e.*")


def cohen_d(df: DataFrame, values: list[str], entity: list[str], label: str = "experimental_label", contrasts: dict[str, tuple[str, str]] = CONTRASTS) -> DataFrame:
    """Pooled-spread effect size between the rows of two labels, for every entity and contrast.

    NULL unless both labels have two values or more and the pooled spread is positive.
    """
    labels, lab = _labels(contrasts), F.col(label)
    when = lambda v, x: F.when(lab == x, _missing_is_null(F.col(v)))
    rows = df.groupBy(*entity).agg(*[a for v in values for x in labels for a in (F.count(when(v, x)).alias(f"{v}__{x}__n"), F.avg(when(v, x)).alias(f"{v}__{x}__m"), F.var_samp(when(v, x)).alias(f"{v}__{x}__s"))])

    def size(v: str, base: str, follow: str) -> Column:
        n0, n1, m0, m1, s0, s1 = (F.col(f"{v}__{x}__{k}") for k in "nms" for x in (base, follow))
        pooled = F.sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / F.nullif(n0 + n1 - 2, F.lit(0)))
        return F.when((n0 >= 2) & (n1 >= 2) & (pooled > 0), (m1 - m0) / F.nullif(pooled, F.lit(0.0)))

    structs = [F.struct(F.lit(n).alias("contrast"), *[size(v, b, f).alias(f"{v}__cohen_d") for v in values]) for n, (b, f) in contrasts.items()]
    return rows.select(*entity, F.explode(F.array(*structs)).alias("c")).select(*entity, "c.*")


def complete_entities(df: DataFrame, entity: str, cells: list[str], n_cells: int) -> DataFrame:
    """Rows of the entities that occur in exactly ``n_cells`` distinct combinations of ``cells``."""
    full = df.groupBy(entity).agg(F.countDistinct(F.struct(*cells)).alias("n")).where(F.col("n") == n_cells)
    return df.join(full, entity, "left_semi")


def composition(df: DataFrame, values: list[str], groups: list[str]) -> DataFrame:
    """Each value's share of a group's total absolute change, with the sum of all changes (closure)."""
    total = reduce(lambda a, b: a + b, [F.abs(F.col(v)) for v in values])
    closure = reduce(lambda a, b: a + b, [F.col(v) for v in values])
    return df.select(*groups, *[F.try_divide(F.abs(F.col(v)), total).alias(f"{v}__share") for v in values], *[F.signum(F.col(v)).alias(f"{v}__sign") for v in values], closure.alias("closure_error"))

"""Average ranks, paired rank tests, correlations and corrections for many tests."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochloom.operators.checks import join_null_safe
from epochloom.session import cut

NEAR_ZERO = 1e-12
EXACT_PAIRS = 50


def average_rank(value: Column, partition: list[str]) -> Column:
    """Rank from 1 within the partition, equal values sharing the mean of their ranks.

    The mean of the first and the last rank of the equal values; both come from one sort.
    """
    w = Window.partitionBy(*partition).orderBy(value)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_k``, the row's number from 1 in its group's order, ``_n``, the size of the group, and ``_part``.

    Rows are sorted by range partitions of (keys, order); each numbers its own, and the offset of a
    partition is the sum of those before it. So no group is sorted in one task, unless it has a third of
    its rows at one place of the order. NULL keys are a group; ties are numbered as they come.
    """
    # Written once: offsets and rows must come from the same partition bounds.
    placed = cut(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    offsets = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("_n"))
    same = placed["_part"] == offsets["_at"]
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(offsets[f"_key{i}"])
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return placed.withColumn("_own", inside).join(offsets, same).withColumn("_k", F.col("_before") + F.col("_own")).drop("_own", "_before", "_at", *[f"_key{i}" for i in range(len(keys))])


#: A value with at least this share of all rows is met by its rows in several tasks; there are at most as many such values as it takes.
_HOT = 20_000


def ranked_rows(rows: DataFrame, keys: list[str], value: str, salts: int = 8) -> DataFrame:
    """``rows`` (keys, value and others) with ``rank``, the mean rank of the value within its group; no value may be NULL or NaN.

    Distinct values are counted, sorted by range partitions of (keys, value), and each partition adds up its
    own counts on top of those of the partitions before it. Rows then meet their value's rank in a join by a
    hash; rows of hot values do so in ``salts`` tasks. NULL keys are a group.
    """
    # Written once: offsets and ranks must come from the same partition bounds.
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_equal"))
    ordered = cut(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy(*keys, "_part").agg(F.sum("_equal").alias("_rows"))
    offsets = sizes.select(*keys, "_part", (F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_rows")).alias("_before"))
    upto = F.sum("_equal").over(Window.partitionBy(*keys, "_part").orderBy(value))
    known = join_null_safe(ordered.withColumn("_upto", upto), offsets, [*keys, "_part"])
    hot = F.col("_equal") * _HOT >= ordered.agg(F.sum("_equal")).scalar()
    number = lambda salt: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in [*keys, value]], salt)
    some = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    lookup = known.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col(value).alias("_rv"), (F.col("_before") + F.col("_upto") - F.col("_equal") + (F.col("_equal") + 1) / 2).alias("rank"), number(F.lit(None)).alias("_plain"), some.alias("_salt"))
    lookup = lookup.withColumn("_k", F.xxhash64("_plain", "_salt")).drop("_plain", "_salt")
    often = ordered.where(hot).select(number(F.lit(None)).alias("_often"))
    salted = rows.withColumn("_plain", number(F.lit(None)))
    salted = salted.join(F.broadcast(often), F.col("_plain") == F.col("_often"), "left").withColumn("_key", F.xxhash64("_plain", F.when(F.col("_often").isNull(), 0).otherwise(F.floor(F.rand(1) * salts).cast("int"))))
    # Partitioned and sorted by one number; what it stands for must agree, too.
    agree = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull())
    same = reduce(lambda x, y: x & y, [agree(k, f"_r{k}") for k in keys], agree(value, "_rv"))
    return salted.join(lookup, (F.col("_key") == F.col("_k")) & same).drop("_plain", "_often", "_key", "_k", "_rv", *[f"_r{k}" for k in keys])


def spread_offsets(df: DataFrame, keys: list[str], order: list[Column], out: str, width: float = 1.0) -> DataFrame:
    """``df`` with offsets spread evenly over [-width/2, width/2] by rank; a single row sits at 0."""
    at = numbered(df, keys, order)
    return at.withColumn(out, F.when(F.col("_n") > 1, ((F.col("_k") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)) - 0.5) * width).otherwise(0.0)).drop("_k", "_n", "_part")


def adjust_pvalues(df: DataFrame, p: str, families: list[str], method: str = "fdr_bh", out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg or Bonferroni adjustment within each family; NULL and NaN p stay NULL.

    Without families all tests are one. Tests are numbered by range partitions; the least later value of
    a partition comes from one row per later partition, so a family of any size is no one task's work.
    """
    base = df.withColumn("_p", F.when(~F.isnan(F.col(p)), F.col(p)))
    if method == "bonferroni":
        sizes = base.groupBy(*families).agg(F.count("_p").alias("_tests"))
        if families:
            joined = join_null_safe(base, sizes, families)
        else:
            joined = base.withColumn("_tests", sizes.scalar())
        return joined.withColumn(out, F.least(F.col("_p") * F.col("_tests"), F.lit(1.0))).drop("_p", "_tests")
    if method != "fdr_bh":
        raise ValueError(f"unknown method {method}")
    base = cut(base)  # tests with and without a p-value go separate ways; neither is computed again
    without = base.where("_p IS NULL").withColumn(out, F.lit(None).cast("double")).drop("_p")
    tests = numbered(base.where("_p IS NOT NULL"), families, [F.col("_p")]).withColumn("_raw", F.col("_p") * F.col("_n") / F.col("_k"))
    least = tests.groupBy(*families, "_part").agg(F.min("_raw").alias("_least"))
    later = Window.partitionBy(*families).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = least.select(*families, "_part", F.min("_least").over(later).alias("_after"))
    own = Window.partitionBy(*families, "_part").orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = join_null_safe(tests.withColumn("_own", F.min("_raw").over(own)), after, [*families, "_part"])
    return adjusted.withColumn(out, F.least(F.col("_own"), F.coalesce("_after", F.lit(1.0)), F.lit(1.0))).select(*without.columns).unionByName(without)


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n sign patterns give each sum of positive ranks 1..n."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy()
    return counts


def signed_rank_p(n: int, statistic: float, tie_term: float, zeros: int) -> float | None:
    """Two-sided p of the smaller rank sum of n nonzero differences: exact for up to EXACT_PAIRS pairs
    without ties and zeros, else the normal approximation with tie correction."""
    if n == 0:
        return None
    if n <= EXACT_PAIRS and tie_term == 0 and zeros == 0:
        return float(min(1.0, 2 * _signed_rank_counts(n)[: int(statistic) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    if variance <= 0:
        return None
    return math.erfc(abs(statistic - n * (n + 1) / 4) / math.sqrt(variance) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(n: pd.Series, statistic: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), b, c, int(d)) if a and b == b else None for a, b, c, d in zip(n, statistic, ties, zeros, strict=True)], dtype=float)


def paired_signed_rank(
    df: DataFrame, values: list[str], groups: list[str], subject: str = "subject", condition: str = "condition", treatment: str = "DMT", control: str = "placebo", with_p: bool = True,
) -> DataFrame:
    """Paired signed-rank test on subject means, per group and value.

    Returns (groups, metric, n_pairs, n_nonzero_pairs, mean_treatment, mean_control, median_difference,
    statistic, rank_biserial[, p_value]). Subjects need a mean under both conditions; differences
    within NEAR_ZERO of 0 have no rank. Without a nonzero pair statistic, rank_biserial and p are NULL.
    """
    cond = F.col(condition)
    sides = (("t", treatment), ("c", control))
    means = df.where(cond.isin(treatment, control) & F.col(subject).isNotNull()).groupBy(*groups, subject).agg(
        *[F.avg(F.when(cond == side, F.when(~F.isnan(F.col(v)), F.col(v)))).alias(f"{v}__{k}") for v in values for k, side in sides]
    )
    long = means.select(*groups, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}__t").alias("t"), F.col(f"{v}__c").alias("c")) for v in values])).alias("x")).select(*groups, "x.*")
    cell = [*groups, "metric"]
    pairs = long.where("t IS NOT NULL AND c IS NOT NULL").withColumn("d", F.col("t") - F.col("c"))
    # Equal up to rounding is equal: differences are ranked by their twelfth decimal.
    size = F.round(F.abs(F.col("d")), 12)
    pairs = pairs.withColumn("nonzero", F.abs("d") > NEAR_ZERO).withColumn("size", size)
    ranked = pairs.withColumn("rank", F.when(F.col("nonzero"), average_rank(F.col("size"), [*cell, "nonzero"]))).withColumn("ties", F.when(F.col("nonzero"), F.count(F.lit(1)).over(Window.partitionBy(*cell, "nonzero", "size"))))
    plus, minus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0))
    out = ranked.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("nonzero").cast("long")).alias("n_nonzero_pairs"), F.avg("t").alias("mean_treatment"), F.avg("c").alias("mean_control"),
        F.median("d").alias("median_difference"), F.when(F.sum("rank") > 0, F.least(plus, minus)).alias("statistic"), F.try_divide(plus - minus, plus + minus).alias("rank_biserial"),
        F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).cast("double").alias("_ties"),
    )
    if with_p:
        # Each tied value contributes t^2 - 1, so a tie of t values adds t^3 - t.
        out = out.withColumn("p_value", _signed_rank_p("n_nonzero_pairs", "statistic", "_ties", F.col("n_pairs") - F.col("n_nonzero_pairs")))
    return out.drop("_ties")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; NULL instead of an error without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _rank_pairs(df: DataFrame, n_left: int, n_right: int, groups: list[str]) -> DataFrame:
    """(groups, _l, _r, x, y): the ranks of every pair of columns _a*, _b*, among the rows where neither is missing.

    A column's ranks serve all partners without missing values; only for a partner with some it is ranked apart.
    """
    names = [*[f"_a{i}" for i in range(n_left)], *[f"_b{i}" for i in range(n_right)]]
    # Written once: row numbers must stay the same.
    keyed = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    gaps = keyed.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first()
    partner = lambda c: c if gaps[c] else None
    wanted = {(f"_a{i}", partner(f"_b{k}")) for i in range(n_left) for k in range(n_right)} | {(f"_b{k}", partner(f"_a{i}")) for i in range(n_left) for k in range(n_right)}
    code = {pair: number for number, pair in enumerate(sorted(wanted, key=str))}
    cells = F.array(*[F.struct(F.lit(number).alias("_c"), (F.when(F.col(other).isNotNull(), F.col(c)) if other else F.col(c)).alias("_v")) for (c, other), number in code.items()])
    long = keyed.select(*groups, "_row", F.explode(F.filter(cells, lambda s: s["_v"].isNotNull())).alias("s")).select(*groups, "_row", "s.*")
    ranks = ranked_rows(long, [*groups, "_c"], "_v").groupBy("_row").agg(*[F.max(F.when(F.col("_c") == n, F.col("rank"))).alias(f"_{n}") for n in range(len(code))])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("_l"), F.lit(k).alias("_r"), *[F.when(F.col(f"_a{i}").isNotNull() & F.col(f"_b{k}").isNotNull(), F.col(f"_{code[own, partner(other)]}")).alias(name) for name, own, other in (("x", f"_a{i}", f"_b{k}"), ("y", f"_b{k}", f"_a{i}"))])
        for i in range(n_left) for k in range(n_right)
    ])
    return keyed.join(ranks, "_row", "left").select(*groups, F.explode(pairs).alias("p")).select(*groups, "p.*")


def correlation_matrix(df: DataFrame, left: list[str], right: list[str], groups: list[str], methods: tuple[str, ...] = ("pearson", "spearman"), least: int = 30) -> DataFrame:
    """Correlation of every left with every right column per group, in long form.

    (groups, left, right, method, n_used, n_missing, correlation, enough): pairs with a missing side
    are left out before ranking; below ``least`` pairs, or without variance, the correlation is NULL.
    """
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    # Columns go by number until the end.
    cells = df.select(*groups, F.posexplode(F.array(*[finite(a) for a in left])).alias("_l", "x"), F.array(*[finite(b) for b in right]).alias("_rs"))
    long = cells.select(*groups, "_l", "x", F.posexplode("_rs").alias("_r", "y"))
    cell = [*groups, "_l", "_r"]
    used = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    parts = []
    for method in methods:
        rows = long if method == "pearson" else _rank_pairs(df.select(*groups, *[finite(a).alias(f"_a{i}") for i, a in enumerate(left)], *[finite(b).alias(f"_b{i}") for i, b in enumerate(right)]), len(left), len(right), groups)
        parts.append(rows.groupBy(*cell).agg(used.alias("n_used"), (F.count(F.lit(1)) - used).alias("n_missing"), F.when(used >= least, safe_corr("x", "y")).alias("correlation")).withColumn("method", F.lit(method)))
    name = lambda names, c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*groups, name(left, "_l").alias("left"), name(right, "_r").alias("right"), "n_used", "n_missing", "correlation", "method", (F.col("n_used") >= least).alias("enough"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom."""
    if n < 3 or r != r:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, int(b)) if a == a and a is not None else None for a, b in zip(r, n, strict=True)], dtype=float)


def stager_agreement(df: DataFrame, metrics: list[str], alignment: list[str], groups: list[str], stager: str = "stager", with_p: bool = True) -> DataFrame:
    """Correlation of every metric between every two stagers on aligned epochs.

    (groups, stager_a, stager_b, metric, n_epochs, correlation[, p_value]). Alignment keys must be
    unique per stager, else repeated keys pair up.
    """
    cols = list(dict.fromkeys([*groups, *alignment]))
    a = df.select(*cols, F.col(stager).alias("stager_a"), *[F.col(m).alias(f"{m}__a") for m in metrics])
    b = df.select(*[F.col(c).alias(f"_{c}") for c in cols], F.col(stager).alias("stager_b"), *[F.col(m).alias(f"{m}__b") for m in metrics])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    pairs = a.join(b, same & (F.col("stager_a") < F.col("stager_b")))
    long = pairs.select(*groups, "stager_a", "stager_b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__a").alias("x"), F.col(f"{m}__b").alias("y")) for m in metrics])).alias("m")).select(*groups, "stager_a", "stager_b", "m.*")
    n = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    out = long.groupBy(*groups, "stager_a", "stager_b", "metric").agg(n.alias("n_epochs"), safe_corr("x", "y").alias("correlation"))
    return out.withColumn("p_value", correlation_p_value("correlation", "n_epochs")) if with_p else out

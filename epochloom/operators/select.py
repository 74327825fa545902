"""Exact order statistics per group without holding a group in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochloom.session import cut

_DIGIT_BITS = 16


@F.pandas_udf(T.LongType())
def ordered_bits(value: pd.Series) -> pd.Series:
    """The IEEE bits of a double, rearranged so that BIGINT order is the order of the doubles."""
    bits = (value.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))


def same_keys(keys: list[str], left: str, right: str):
    """Equality of key columns of two aliased sides in which NULL matches NULL."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def select_ranks(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """The values at given 1-based ranks, per group, by a radix descent over 16-bit digits.

    ``wanted`` has the keys, ``target`` (an id) and ``rank``. Each of the four rounds counts the
    digits below the prefixes found so far (a map-side aggregation of at most 65,536 counters per
    group and prefix) and keeps the digit that holds the rank: a group may have any number of rows,
    ties included, and a row is counted once however many ranks are wanted. Ranks outside 1..n give
    no row. Values must not be NULL or NaN; NULL keys match NULL.

    Returns the keys, target, value.
    """
    # Written once: every round reads it.
    coded = cut(rows.select(*keys, F.col(value).alias("_v"), ordered_bits(F.col(value)).alias("_x")))
    state = wanted.select(*keys, "target", F.col("rank").alias("_rank"), F.lit(None).cast("long").alias("_prefix"))
    for step in range(64 // _DIGIT_BITS):
        shift = 64 - _DIGIT_BITS * (step + 1)
        near = coded.alias("r")
        if step:
            near = near.join(state.select(*keys, "_prefix").distinct().alias("s"), same_keys(keys, "r", "s") & (F.shiftright("r._x", shift + _DIGIT_BITS) == F.col("s._prefix")), "left_semi")
        counted = near.groupBy(*keys, F.shiftright("_x", shift).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        same = same_keys(keys, "c", "s")
        if step:
            same = same & (F.shiftright("c._p", _DIGIT_BITS) == F.col("s._prefix"))
        met = state.alias("s").join(counted.alias("c"), same)
        upto = Window.partitionBy(*keys, "target").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        state = (
            met.select(*[F.col(f"s.{k}").alias(k) for k in keys], "target", "_rank", "_p", "_n").withColumn("_upto", F.sum("_n").over(upto))
            .where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
            .select(*keys, "target", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_p").alias("_prefix"))
        )
        state = cut(state)  # one row per group and target; the next round uses it twice
    same = same_keys(keys, "r", "s") & (F.col("r._x") == F.col("s._prefix"))
    return coded.alias("r").join(state.alias("s"), same).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "target").agg(F.max("r._v").alias("value"))


def percentiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Percentiles per group, interpolated between neighbouring ranks: the keys and ``p``, one per fraction in an array.

    NULL and NaN values don't count; a group without values has no row. NULL keys are a group.
    """
    v = F.col(value).cast("double")
    some = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_value"))
    sizes = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.flatten(F.array(*[F.array(F.floor(at(q)) + 1, F.ceil(at(q)) + 1) for q in fractions]))
    wanted = sizes.select(*keys, F.posexplode(ranks).alias("target", "rank"))
    found = select_ranks(some, keys, "_value", wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("_found"))
    both = found.alias("f").join(sizes.alias("n"), same_keys(keys, "f", "n")).select(*[F.col(f"n.{k}").alias(k) for k in keys], "_found", "_n")
    low, high = (lambda i: F.col("_found")[F.lit(2 * i)]), (lambda i: F.col("_found")[F.lit(2 * i + 1)])
    return both.select(*keys, F.array(*[low(i) + (high(i) - low(i)) * (at(q) - F.floor(at(q))) for i, q in enumerate(fractions)]).alias("p"))

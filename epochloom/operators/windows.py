"""Analytic functions within groups: scores, rolling context, robust scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def zscore(value: Column, partition: list[str]) -> Column:
    """Distance from the group's mean in sample standard deviations; NULL for a group without spread."""
    w = Window.partitionBy(*partition)
    return (value - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))


def trailing_mean(value: Column, partition: list[str], order: list[str], rows: int = 4) -> Column:
    return F.avg(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - rows, 0))


def triangular_mean(value: Column, partition: list[str], order: list[str], rows: int = 15) -> Column:
    """Centred mean with triangular weights, renormalised over the neighbours that exist and aren't NULL."""
    w = Window.partitionBy(*partition).orderBy(*order)
    half = rows // 2
    near = {k: (F.lag(value, -k).over(w) if k <= 0 else F.lead(value, k).over(w)) for k in range(-half, half + 1)}
    weight = {k: float(half + 1 - abs(k)) for k in near}
    total = reduce(lambda a, b: a + b, [F.coalesce(v * weight[k], F.lit(0.0)) for k, v in near.items()])
    norm = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), weight[k]).otherwise(0.0) for k, v in near.items()])
    return total / F.nullif(norm, F.lit(0.0))


def robust_scale(value: Column, partition: list[str], low: float = 0.05, high: float = 0.95) -> Column:
    """(value - median) over the spread of the outer percentiles; NULL for a group without spread."""
    w = Window.partitionBy(*partition)
    spread = F.percentile(value, F.lit(high)).over(w) - F.percentile(value, F.lit(low)).over(w)
    return (value - F.median(value).over(w)) / F.nullif(spread, F.lit(0.0))


def elapsed_share(time: Column, partition: list[str]) -> Column:
    """Time over the group's last time; NULL where that is 0."""
    return F.try_divide(time, F.max(time).over(Window.partitionBy(*partition)))


def seeded_offsets(key: Column, seed: int, width: float = 1.0) -> Column:
    """Offsets spread evenly by chance over [-width/2, width/2), the same for a key and seed anywhere."""
    part = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double")
    return (part / float(16**8) - 0.5) * width


def even_offsets(partition: list[str], order: list[str], width: float = 1.0) -> Column:
    """Offsets spread evenly over [-width/2, width/2] by rank; a single row sits at 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    k = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return F.when(n > 1, (k / F.nullif(n - 1, F.lit(0)) - 0.5) * width).otherwise(0.0)

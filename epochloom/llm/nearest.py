"""Problem 2: records of two tables paired by nearest time, as a range join on disjoint intervals.

Every right-hand time owns the interval of times nearer to it than to its neighbours, cut off at the
tolerance. The intervals of a key are disjoint and at most twice the tolerance long, so they are
indexed by bins of that width: a left-hand time meets the few intervals of its own bin, whatever the
size of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_intervals(right: DataFrame, keys: list[str], time: str, payload: str, tolerance: int, bin_width: int | None = None) -> DataFrame:
    """(keys, payload, lo2, lo_open, hi2): per right-hand time the doubled bounds of its interval.

    Doubled, because the midpoint of two whole times may be a half. Of several rows at one time the
    smallest payload counts. Neighbours are found within time bins that also hold a margin of twice
    the tolerance: a neighbour further away can't bound an interval.
    """
    width = bin_width or max(40 * tolerance, 1)
    once = right.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_t")).agg(F.min(payload).alias(payload))
    spread = once.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_t") - 2 * tolerance) / width), F.floor((F.col("_t") + 2 * tolerance) / width))))
    w = Window.partitionBy(*keys, "_bin").orderBy("_t")
    near = spread.withColumns({"_prev": F.lag("_t").over(w), "_next": F.lead("_t").over(w)}).where(F.col("_bin") == F.floor(F.col("_t") / width))
    t2 = 2 * F.col("_t")
    lo_tie = F.col("_prev") + F.col("_t")
    lo_open = F.coalesce(lo_tie >= t2 - 2 * tolerance, F.lit(False))
    return near.select(
        *keys, payload,
        F.when(lo_open, lo_tie).otherwise(t2 - 2 * tolerance).alias("lo2"), lo_open.alias("lo_open"),
        F.least(t2 + 2 * tolerance, F.coalesce(F.col("_next") + F.col("_t"), t2 + 2 * tolerance)).alias("hi2"),
    )


def match_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, time: str, payload: str, tolerance: int) -> DataFrame:
    """(left_id, payload) of the nearest right-hand row within the tolerance (inclusive), per left row.

    ``time`` is BIGINT (say, microseconds) on both sides. NULL keys or times match nothing; of two
    right-hand times equally far the earlier wins, of several rows at that time the smallest payload.
    Every left row is judged, repeated ones too. Either side empty gives no rows; other columns may
    bear any name.
    """
    index_width = 2 * max(tolerance, 1)
    spans = nearest_intervals(right.select(*keys, time, payload), keys, time, payload, tolerance)
    index = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo2") / (2 * index_width)), F.floor(F.col("hi2") / (2 * index_width)))))
    probes = left.where(F.col(time).isNotNull()).select(*keys, F.col(left_id).alias("_id"), (2 * F.col(time)).alias("_t2"), F.floor(F.col(time) / index_width).alias("_bin"))
    after_lo = F.when(F.col("lo_open"), F.col("_t2") > F.col("lo2")).otherwise(F.col("_t2") >= F.col("lo2"))
    return probes.join(index, [*keys, "_bin"]).where(after_lo & (F.col("_t2") <= F.col("hi2"))).select(F.col("_id").alias(left_id), payload)

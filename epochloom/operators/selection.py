"""Choosing one candidate per group, with an audit of what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_preferred(df: DataFrame, groups: list[str], preference: list[Column], name: str) -> DataFrame:
    """Per group the first row by ``preference``: (groups, selected, dropped, n_candidates).

    ``dropped`` joins the other names in order by ';', '' for none. NULL groups are groups.
    """
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(*preference)) == 1
    marked = df.withColumn("_first", first)
    return marked.groupBy(*groups).agg(
        F.max(F.when(F.col("_first"), F.col(name))).alias("selected"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_first"), F.col(name)))), ";").alias("dropped"), F.count(F.lit(1)).alias("n_candidates")
    )


def d5_preference(condition: Column, d_index: Column, name: Column) -> list[Column]:
    """Treatment sessions: index 5 before all, then the highest; control sessions: index 1."""
    treated = condition != "placebo"
    return [F.when(treated, d_index == 5).otherwise(d_index == 1).desc(), F.when(treated, d_index).desc_nulls_last(), name.asc()]


def session_fallback(df: DataFrame, groups: list[str], session: str, order: list[str]) -> DataFrame:
    """Rows of the first listed session of a group that has exactly one row."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(session))
    listed = df.where(rank > 0).withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*groups, session))).where("_n = 1")
    return listed.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy("_rank"))).where("_k = 1").drop("_rank", "_n", "_k")


def top_by_size(df: DataFrame, value: str, tiebreak: list[str], n: int) -> DataFrame:
    """The n rows largest in absolute value, NULLs last, ties broken by ``tiebreak``."""
    return df.orderBy(F.abs(F.col(value)).desc_nulls_last(), *tiebreak).limit(n)

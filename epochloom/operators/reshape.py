"""Pivots with checks, formatted cells, and columns chosen by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.operators.checks import require_unique


def pivot_unique(df: DataFrame, index: list[str], column: str, names: list, value: str, check: bool = True) -> DataFrame:
    """One row per index and one column per name of ``column``; NULL where the index lacks it.

    Raises if an index has a name twice (one job when the query is built, left out with ``check`` False,
    where the greater value stays). Other names than those given are left out.
    """
    kept = df.where(F.col(column).isin(names)).select(*index, column, value)
    if check:
        require_unique(kept, [*index, column], f"pivot by {column}")
    return kept.groupBy(*index).pivot(column, names).agg(F.max(value))


def pivot_cells(df: DataFrame, index: list[str], column: str, names: list, pattern: str, *values: Column) -> DataFrame:
    """Formatted cells, one column per name; '' where the index lacks it."""
    cells = df.select(*index, column, F.format_string(pattern, *values).alias("_cell"))
    return cells.groupBy(*index).pivot(column, names).agg(F.max("_cell")).na.fill("", [str(n) for n in names])


def columns_by_suffix(df: DataFrame, keep: list[str], suffixes: tuple[str, ...], prefix: str) -> DataFrame:
    """The ``keep`` columns, and those whose name ends in one of the suffixes under a new prefix.

    Raises if no column has one of the suffixes.
    """
    chosen = [c for c in df.columns if c not in keep and c.endswith(suffixes)]
    if not chosen:
        raise ValueError(f"no column ends in {suffixes}")
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in chosen])

"""Contracts on tables: required columns, unique keys, null-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: list[str], label: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks {missing}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of every key combination borne by more than one row; NULLs are equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str], label: str) -> None:
    """Raise with the number of offending rows (all members of a duplicate key count)."""
    require_columns(df, keys, label)
    n = duplicate_keys(df, keys).agg(F.sum("n_rows")).first()[0]
    if n:
        raise ValueError(f"{label}: {n} rows share a key {keys}")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys and all other columns remain."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same: Column = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__{k}"])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def numeric_columns(df: DataFrame, exclude: set[str]) -> list[str]:
    """Numeric columns that aren't metadata, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def with_prefix(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one of the two tables has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both tables have the same set of keys, with up to five that only one has."""
    odd = symmetric_difference(left, right, key).limit(5).collect()
    if odd:
        raise ValueError(f"{key} only on one side: {[(r[0], r['side']) for r in odd]}")


def require_single(df: DataFrame, column: str, value=None) -> DataFrame:
    """Rows of one value of a column: the given one, or the only one there is; else raise."""
    if value is None:
        found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"{column} has {'no value' if not found else 'several values'}; name one")
        value = found[0]
    chosen = df.where(F.col(column) == value)
    if chosen.isEmpty():
        raise ValueError(f"{column} has no rows of {value!r}")
    return chosen


def first_appearance(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values of a column in the order in which they first appear by ``position``."""
    return df.groupBy(column).agg(F.min(position).alias("first_position")).orderBy("first_position", column)


def read_figure_input(df: DataFrame, required: dict[str, str], label: str) -> DataFrame:
    """The required columns of an exported table, cast to their types; cells that don't fit are NULL."""
    require_columns(df, list(required), label)
    return df.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in required.items()])

"""Table scans by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, unfiltered."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Turn NaN into NULL in the named (default: all) floating-point columns.

    Spark averages propagate NaN and compares NaN as the largest value; the data model treats NaN
    and NULL alike as missing.
    """
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    chosen = [c for c in floats if not columns or c in columns]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in chosen})


def clean_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan with NaN normalised to NULL."""
    return nan_to_null(table(spark, folder, name))

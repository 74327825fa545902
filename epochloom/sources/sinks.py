"""Sinks: tables by suffix, one recording's or a whole study's results, status, inventories."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators.checks import require_same_keys

OPTIONAL = ("spectra", "staging_qc")


def save_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write by suffix: .parquet, .csv (with header) or .json; the commit protocol makes it all or nothing.

    ``single_file`` is for small reports: it writes from one task.
    """
    suffix = os.path.splitext(path)[1]
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if suffix == ".parquet":
        writer.parquet(path)
    elif suffix == ".csv":
        writer.option("header", True).csv(path)
    elif suffix == ".json":
        writer.json(path)
    else:
        raise ValueError(f"can't save as {suffix or 'a path without suffix'}")


def save_results(tables: dict[str, DataFrame], folder: str, key: str = "recording_id") -> dict[str, str]:
    """Write each table partitioned by recording, replacing the partitions that occur only.

    Empty optional tables are skipped. Returns where each table went.
    """
    written = {}
    for name, df in tables.items():
        if name in OPTIONAL and df.isEmpty():
            continue
        path = os.path.join(folder, f"{name}.parquet")
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        written[name] = path
    return written


def write_text(path: str, content: str) -> None:
    """Driver-side small file, replaced in one step."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(f"{path}.tmp", path)


def write_status(folder: str, recording_id: str, status: dict) -> str:
    path = os.path.join(folder, "_status", f"{recording_id}.json")
    write_text(path, json.dumps(status, sort_keys=True))
    return path


def export_pack(spark: SparkSession, tables: dict[str, DataFrame], folder: str, key: str = "recording_id") -> str:
    """Write tables with the same recordings to a folder, with an inventory of sizes and hashes beside them.

    Raises if a table lacks recordings that another has. Returns the inventory's path.
    """
    (first, one), *rest = tables.items()
    for name, df in rest:
        try:
            require_same_keys(one, df, key)
        except ValueError as odd:
            raise ValueError(f"{first} and {name}: {odd}") from None
    for name, df in tables.items():
        save_table(df, os.path.join(folder, f"{name}.parquet"))
    where = os.path.join(folder, "_inventory.json")
    save_table(inventory(spark, folder, "part-*"), where, single_file=True)
    return where


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, n_bytes, sha256) of the files below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))

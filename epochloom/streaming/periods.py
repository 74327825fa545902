"""Continuous periods over a stream: the interval map of problem 1 as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from epochloom.operators.intervals import BUCKET_MS, IntervalMap

_STATE = "starts array<long>, ends array<long>"
_OUT = "key string, bucket long, start_ms long, end_ms long, gap_ms long"


def stream_pieces(stream: DataFrame, tolerance_ms: float = 0.0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Disjoint intervals per (key, time bucket) after every micro-batch, for the keys it touched.

    gap_ms is the pause before an interval, 0 for the first of its bucket.

    ``stream`` has key, start_ms, end_ms; rows with a missing time or an end before the start are left
    out. Late rows merge into what is there. The state of a bucket holds its disjoint intervals only.
    """
    rows = stream.where("key IS NOT NULL AND start_ms IS NOT NULL AND end_ms >= start_ms").withColumn("bucket", F.floor(F.col("start_ms") / bucket_ms))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        held = IntervalMap(tolerance_ms, starts, ends)
        for batch in batches:
            for start, end in zip(batch["start_ms"].tolist(), batch["end_ms"].tolist(), strict=True):
                held.insert(start, end)
        state.update((held.starts, held.ends))
        yield pd.DataFrame({"key": key[0], "bucket": key[1], "start_ms": held.starts, "end_ms": held.ends, "gap_ms": [g or 0 for g in held.gaps]})

    return rows.groupBy("key", "bucket").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Drain what the stream's source holds now; every micro-batch is written once, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(pieces: DataFrame) -> DataFrame:
    """The newest intervals of every (key, bucket) among all batches written."""
    newest = pieces.groupBy("key", "bucket").agg(F.max("batch").alias("batch"))
    return pieces.join(newest, ["key", "bucket", "batch"]).select("key", "bucket", "start_ms", "end_ms")


def sessions(stream: DataFrame, time: str, key: str, gap: str, watermark: str) -> DataFrame:
    """Sessions of a stream by event time: (key, session start and end, n); late rows beyond the watermark drop."""
    grouped = stream.withWatermark(time, watermark).groupBy(F.col(key), F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

"""Continuous runs, whole epochs and context blocks of discontinuous samples, as window plans.

Windows are partitioned by recording, whose length is bounded by the recording itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampling_frequency(samples: DataFrame, recording: str, trial: str, time: str) -> DataFrame:
    """(recording, sampling_frequency): one over the median, over trials, of the median positive step."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(recording, trial).orderBy(time))
    per_trial = samples.withColumn("_step", step).where("_step > 0").groupBy(recording, trial).agg(F.median("_step").alias("_m"))
    return per_trial.groupBy(recording).agg((1 / F.median("_m")).alias("sampling_frequency"))


def label_runs(samples: DataFrame, recording: str, time: str, step: float) -> DataFrame:
    """Adds break_before, run_number (from 0) and position (from 0 within the run).

    A sample starts a new run when its distance from the sample before differs from ``step`` by more
    than a tenth of it (and 1e-7). Samples with a NULL time aren't samples; equal times are a break.
    """
    by_time = Window.partitionBy(recording).orderBy(time)
    gap = F.col(time) - F.lag(time).over(by_time)
    off = F.abs(gap - step) > max(0.1 * step, 1e-7)
    flagged = samples.where(F.col(time).isNotNull()).withColumn("break_before", F.coalesce(off, F.lit(False)))
    numbered = flagged.withColumn("run_number", F.sum(F.col("break_before").cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("position", F.row_number().over(Window.partitionBy(recording, "run_number").orderBy(time)) - 1)


def whole_epochs(labelled: DataFrame, recording: str, time: str, per_epoch: int) -> DataFrame:
    """Epochs of ``per_epoch`` samples per run, anchored at the run's start; the tail is dropped.

    (recording, run_number, epoch_in_run, start_time, end_time, label_time): label_time is the median
    sample time. Runs shorter than an epoch give none but keep their number.
    """
    epoch = F.floor(F.col("position") / per_epoch)
    grouped = labelled.groupBy(recording, "run_number", epoch.alias("epoch_in_run")).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.median(time).alias("label_time"), F.count(F.lit(1)).alias("_n"))
    return grouped.where(F.col("_n") == per_epoch).drop("_n")


def run_table(labelled: DataFrame, recording: str, time: str, per_epoch: int) -> DataFrame:
    """(recording, run_number, start_time, end_time, n_samples, n_epochs, discarded_tail) of runs with an epoch.

    end_time is the last sample of the last whole epoch.
    """
    n = F.count(F.lit(1))
    size = labelled.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(recording, "run_number")))
    kept = size.withColumn("_kept", F.floor(F.col("_size") / per_epoch) * per_epoch)
    runs = kept.groupBy(recording, "run_number").agg(
        F.min(time).alias("start_time"), F.max(F.when(F.col("position") < F.col("_kept"), F.col(time))).alias("end_time"), n.alias("n_samples"),
        F.floor(n / per_epoch).alias("n_epochs"), (n % per_epoch).alias("discarded_tail"),
    )
    return runs.where("n_epochs > 0")


def context_blocks(runs: DataFrame, recording: str, step: float, tolerance: float) -> DataFrame:
    """Adds gap_seconds (silence before the run, at least 0) and block_number to a run table.

    A run joins the block before it when the gap is at most ``tolerance``.
    """
    w = Window.partitionBy(recording).orderBy("start_time")
    gap = F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(w) - step)
    first = F.lag("end_time").over(w).isNull()
    with_gap = runs.withColumn("gap_seconds", F.when(first, None).otherwise(gap))
    fresh = F.when(F.col("gap_seconds") > tolerance, 1).otherwise(0)
    return with_gap.withColumn("block_number", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def epoch_metadata(epochs: DataFrame, blocks: DataFrame, recording: str) -> DataFrame:
    """Epochs with block, epoch_in_block, break_before and gap_before_seconds.

    The first epoch of a later run in a block breaks, with that run's gap; the block's first epoch has a
    NULL gap, every other epoch 0.
    """
    placed = epochs.join(blocks.select(recording, "run_number", "block_number", "gap_seconds"), [recording, "run_number"])
    in_block = F.row_number().over(Window.partitionBy(recording, "block_number").orderBy("start_time")) - 1
    numbered = placed.withColumn("epoch_in_block", in_block)
    fresh = (F.col("epoch_in_run") == 0) & (F.col("epoch_in_block") > 0)
    gap = F.when(F.col("epoch_in_block") == 0, None).when(fresh, F.col("gap_seconds")).otherwise(0.0)
    return numbered.withColumn("break_before", fresh).withColumn("gap_before_seconds", gap).drop("gap_seconds")


def block_facts(blocks: DataFrame, recording: str) -> DataFrame:
    """One row per block: times, largest inner gap (0 for a single run), the gaps in order, sums and counts."""
    w = Window.partitionBy(recording, "block_number").orderBy("start_time")
    inner = blocks.withColumn("_inner", F.when(F.row_number().over(w) > 1, F.col("gap_seconds")))
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("_inner").isNotNull(), F.struct("start_time", "_inner")))), lambda s: s["_inner"])
    return inner.groupBy(recording, "block_number").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), (F.max("end_time") - F.min("start_time")).alias("elapsed_seconds"),
        F.count(F.lit(1)).alias("n_runs"), F.sum("n_epochs").alias("n_epochs"), F.sum("discarded_tail").alias("discarded_tail"),
        F.coalesce(F.max("_inner"), F.lit(0.0)).alias("max_gap_seconds"), gaps.alias("gaps"),
    )

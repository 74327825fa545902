"""State predictors as pluggable callables, and the quality record of what they returned."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.functions.probability import PROBABILITIES, STAGES

#: (epochs x inputs) of one block, in epoch order -> (epochs x 5) probabilities in state order.
Predictor = Callable[[np.ndarray], np.ndarray]


def share_predictor(x: np.ndarray) -> np.ndarray:
    """Deterministic reference predictor: the shares of five non-negative inputs, missing ones as 0."""
    x = np.clip(np.nan_to_num(x), 0, None) + 1e-6
    return x / x.sum(axis=1, keepdims=True)


def run_predictor(df: DataFrame, block: list[str], epoch: str, inputs: list[str], predictor: Predictor, stager: str) -> DataFrame:
    """Apply ``predictor`` to every block: (block, epoch, stager, prob_*, stage, error).

    A block's epochs reach the predictor together and in order (a block is bounded by the recording's
    gaps). A predictor that raises, or returns another shape or invalid probabilities, gives one row for
    the block with NULL probabilities and the error.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*block, epoch]]
    schema = ", ".join([*kinds, "stager string", *[f"{p} double" for p in PROBABILITIES], "stage string", "error string"])
    names = [s.upper() for s in STAGES]

    def predict(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(epoch, kind="stable")
        out = g[[*block, epoch]].assign(stager=stager, stage=None, error=None)
        try:
            p = np.asarray(predictor(g[inputs].to_numpy(dtype=float)), dtype=float)
            if p.shape != (len(g), len(STAGES)):
                raise ValueError(f"expected {(len(g), len(STAGES))}, got {p.shape}")
            if not ((p >= 0) & (p <= 1)).all() or (np.abs(p.sum(axis=1) - 1) > 1e-5).any():
                raise ValueError("rows must be probabilities that add up to 1")
        except Exception as failure:  # a failing block is a result, not the end of the job
            out = out.head(1).assign(error=f"{type(failure).__name__}: {failure}", **dict.fromkeys(PROBABILITIES))
            return out[[*block, epoch, "stager", *PROBABILITIES, "stage", "error"]].astype(dict.fromkeys(PROBABILITIES, float))
        out[list(PROBABILITIES)] = p
        out["stage"] = [names[k] for k in p.argmax(axis=1)]
        return out[[*block, epoch, "stager", *PROBABILITIES, "stage", "error"]]

    return df.select(*block, epoch, *inputs).groupBy(*block).applyInPandas(predict, schema)


def token_means(df: DataFrame, keys: list[str], token: str, per_epoch: int = 6) -> DataFrame:
    """Mean probabilities of every ``per_epoch`` successive tokens."""
    return df.groupBy(*keys, F.floor(F.col(token) / per_epoch).alias("epoch")).agg(*[F.avg(p).alias(p) for p in PROBABILITIES])


def staging_qc(epochs: DataFrame, staged: DataFrame, stagers: Iterable[str], configured: set[str], least_epochs: int, single_unsupported: tuple[str, ...] = ("yasa",)) -> DataFrame:
    """(recording_id, block_id, stager, expected_epochs, returned_epochs, status) for every block and stager."""
    expected = epochs.select("recording_id", "block_id", "epoch").distinct().groupBy("recording_id", "block_id").agg(F.count(F.lit(1)).alias("expected_epochs"))
    grid = expected.withColumn("stager", F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(x.lower() for x in stagers)])))
    returned = staged.groupBy("recording_id", "block_id", "stager").agg(F.countDistinct("epoch").alias("returned"))
    n = F.coalesce("returned", F.lit(0))
    status = (
        F.when(~F.col("stager").isin(*configured), "not_configured")
        .when((F.col("expected_epochs") == 1) & F.col("stager").isin(*single_unsupported), "unsupported_single_epoch")
        .when(F.col("expected_epochs") < least_epochs, "insufficient_epochs").when(n == 0, "failed").otherwise("ok")
    )
    return grid.join(returned, ["recording_id", "block_id", "stager"], "left").select("recording_id", "block_id", "stager", "expected_epochs", n.alias("returned_epochs"), status.alias("status"))

"""Per-epoch signal features: Arrow batches of array columns through numpy kernels, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.functions import kernels


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column grouped by length: (row numbers, rows x samples). Rows with missing samples are left out."""
    lengths = np.array([len(x) if x.is_valid else 0 for x in column])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if n < 2:
            continue
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield rows[good], x[good]


def signal_features(df: DataFrame, keys: list[str], signal: str, names: list[str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(keys, names...) of every row: what ``kernel`` computes from its signal.

    A NULL or empty signal, one of a single sample, or one with missing samples gives NULL features.
    """
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], *[f"`{n}` double" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: np.full(batch.num_rows, np.nan) for n in names}
            for rows, x in _matrix(batch.column(signal)):
                for name, values in kernel(x).items():
                    if name in out:
                        out[name][rows] = values
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(v, from_pandas=True) for v in out.values()]], names=[*keys, *names])

    return df.select(*keys, signal).mapInArrow(run, schema)


def spectra(df: DataFrame, keys: list[str], signal: str, frequency: float, seconds: float = 4.0) -> DataFrame:
    """Long table (keys, frequency_hz, power) of every row's Welch spectrum."""
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], "f array<double>", "p array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f_out: list = [None] * batch.num_rows
            p_out: list = [None] * batch.num_rows
            for rows, x in _matrix(batch.column(signal)):
                f, p = kernels.welch(x, frequency, seconds)
                for r, power in zip(rows, p, strict=True):
                    f_out[r], p_out[r] = f, power
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(f_out, kind), pa.array(p_out, kind)], names=[*keys, "f", "p"])

    wide = df.select(*keys, signal).mapInArrow(run, schema)
    return wide.select(*keys, F.explode(F.arrays_zip("f", "p")).alias("z")).select(*keys, F.col("z.f").alias("frequency_hz"), F.col("z.p").alias("power"))


#: What extract_features() can compute, with the columns each analysis gives.
ANALYSES = {
    "bandpower": [f"bp_rel_{b}" for b in kernels.BANDS],
    "aperiodic": ["specparam_offset", "specparam_exponent", "specparam_r2", "specparam_error"],
    "staging": [f"yasa_eeg_{n}" for n in ("std", "iqr", "skew", "kurt", "nzc", "hmob", "hcomp", *kernels.STAGING_BANDS, "dt", "ds", "db", "at", "abspow", "perm", "higuchi", "petrosian")],
    "series": [f"series_{n}" for n in sorted(kernels.series_features(np.sin(np.arange(64.0))[None, :]))],
}


def extract_features(df: DataFrame, keys: list[str], signal: str, frequency: float, analyses: list[str], range_hz: tuple[float, float] = (1.0, 45.0)) -> DataFrame:
    """All chosen analyses of every signal in one pass: (keys, feature columns, status).

    The Welch spectrum is computed once for band power and the aperiodic fit. status is 'ok', or 'no_signal'
    for a row whose signal is NULL, shorter than two samples or incomplete.
    """
    unknown = [a for a in analyses if a not in ANALYSES]
    if unknown:
        raise ValueError(f"unknown analyses {unknown}")
    names = [n for a in dict.fromkeys(analyses) for n in ANALYSES[a]]

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {"_seen": np.ones(len(x))}
        if {"bandpower", "aperiodic"} & set(analyses):
            f, p = kernels.welch(x, frequency)
            out |= {f"bp_rel_{k}": v for k, v in kernels.band_powers(f, p).items()}
            out |= {f"specparam_{k}": v for k, v in kernels.aperiodic(f, p, *range_hz).items()} if "aperiodic" in analyses else {}
        if "staging" in analyses:
            out |= {f"yasa_eeg_{k}": v for k, v in kernels.staging_features(x, frequency).items()}
        if "series" in analyses:
            out |= {f"series_{k}": v for k, v in kernels.series_features(x).items()}
        return out

    wide = signal_features(df, keys, signal, [*names, "_seen"], kernel)
    return wide.select(*keys, *names, F.when(F.col("_seen").isNotNull(), "ok").otherwise("no_signal").alias("status"))


# Array expressions that stay in the JVM.


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return _sum(a) / F.nullif(F.size(a), F.lit(0))


def array_var(a: Column, ddof: int = 0) -> Column:
    mean = array_mean(a)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.nullif(F.size(a) - ddof, F.lit(0))


def array_diff(a: Column) -> Column:
    n = F.size(a) - 1
    return F.zip_with(F.slice(a, 2, F.greatest(n, F.lit(0))), F.slice(a, 1, F.greatest(n, F.lit(0))), lambda x, y: x - y)


def array_standardize(a: Column) -> Column:
    """Mean 0 and population spread 1; without spread only centred."""
    mean, sd = array_mean(a), F.sqrt(array_var(a))
    return F.transform(a, lambda x: F.when(sd > 0, (x - mean) / F.nullif(sd, F.lit(0.0))).otherwise(x - mean))


def array_zero_crossings(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: F.when((x < 0) != (y < 0), 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)


def chunk_array(a: Column, size: int) -> Column:
    """Consecutive whole pieces of ``size`` values; an incomplete tail is dropped."""
    n = F.floor(F.size(a) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * size + 1, F.lit(size)))).otherwise(F.array())


def reorder_array(a: Column, positions: list[int]) -> Column:
    """Values at the given positions (from 0), in that order."""
    return F.array(*[F.get(a, F.lit(p)) for p in positions])

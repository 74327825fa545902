"""Recording files as a Spark data source, one partition per file, with channel projection.

``spark.read.format("recording").option("path", folder).option("channels", "E1,E9").load()``

A recording is an ``.npz`` archive with ``label`` (channel names) and ``trial_k`` / ``time_k`` arrays, or,
where h5py is installed, a version 7.3 ``.mat`` file with the same members as object references. Trials
may be stored channels-first or samples-first; the time axis decides.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "recording_id string, subject string, session string, condition string, sampling_frequency double, trial int, channel string, times array<double>, data array<float>"
_NAME = re.compile(r"(?P<subject>P\d+)(?P<session>D\d+)")
FREQUENCY_TOLERANCE = 1e-3


def parse_name(path: str) -> tuple[str, str, str, str]:
    """(recording_id, subject, session, condition) of a file name; session D1 is the control."""
    stem = os.path.splitext(os.path.basename(path))[0]
    found = _NAME.search(stem)
    if not found:
        raise ValueError(f"{stem}: no subject and session in the name")
    session = found["session"]
    return stem, found["subject"], session, "placebo" if session == "D1" else "DMT"


def decode_label(raw: bytes) -> str:
    """A UTF-16LE label without its trailing NULs."""
    return raw.decode("utf-16-le").rstrip("\x00")


@dataclass
class _Trial:
    """The shape of a trial's samples, its times, and a function that reads the chosen channels of it, one array each."""

    shape: tuple[int, ...]
    times: np.ndarray
    read: Callable[[list[int], bool], list[np.ndarray]]


def _npz_trial(archive: zipfile.ZipFile, k: int) -> _Trial:
    with archive.open(f"trial_{k}.npy") as f:
        version = np.lib.format.read_magic(f)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = header(f)
        start = f.tell()

    def read(rows: list[int], channels_first: bool) -> list[np.ndarray]:
        with archive.open(f"trial_{k}.npy") as f:
            if channels_first == by_column or len(shape) != 2:  # a channel isn't one stretch of the file
                f.seek(0)
                whole = np.lib.format.read_array(f, allow_pickle=False)
                return [whole[r] if channels_first else whole[:, r] for r in rows]
            n = shape[1] if channels_first else shape[0]
            out = []
            for r in rows:
                f.seek(start + r * n * kind.itemsize)
                out.append(np.frombuffer(f.read(n * kind.itemsize), kind))
            return out

    with archive.open(f"time_{k}.npy") as f:
        return _Trial(shape, np.lib.format.read_array(f, allow_pickle=False).ravel(), read)


@contextmanager
def _opened(path: str) -> Iterator[tuple[list[str], Callable[[], Iterator[_Trial]]]]:
    """Channel labels, and the trials, of which nothing but shapes and times is read yet."""
    if path.endswith(".npz"):
        with zipfile.ZipFile(path) as archive:
            with archive.open("label.npy") as f:
                labels = [str(x) for x in np.lib.format.read_array(f, allow_pickle=False)]
            n = sum(name.startswith("trial_") for name in archive.namelist())
            yield labels, lambda: (_npz_trial(archive, k) for k in range(n))
        return
    try:
        import h5py
    except ImportError as missing:
        raise RuntimeError(f"{path}: reading .mat files needs h5py") from missing
    with h5py.File(path) as f:
        group = f["data_avref_inner"] if "data_avref_inner" in f else f["data_avref"]
        refs = lambda name: [f[r] for r in group[name][()].ravel()]
        one = lambda d, t: _Trial(d.shape, np.ravel(t[()]), lambda rows, first: [d[r] if first else d[:, r] for r in rows])
        yield [decode_label(np.asarray(x[()], "<u2").tobytes()) for x in refs("label")], lambda: (one(d, t) for d, t in zip(refs("trial"), refs("time"), strict=True))


def read_channels(path: str) -> list[str]:
    """Channel labels alone; no samples are read."""
    with _opened(path) as (labels, _):
        return labels


_ARROW = pa.schema([
    ("recording_id", pa.string()), ("subject", pa.string()), ("session", pa.string()), ("condition", pa.string()), ("sampling_frequency", pa.float64()),
    ("trial", pa.int32()), ("channel", pa.string()), ("times", pa.list_(pa.float64())), ("data", pa.list_(pa.float32())),
])


def read_recording(path: str, channels: list[str] | None = None, expected_frequency: float | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of SCHEMA, one per trial, in the requested channel order; empty trials are left out.

    Only the requested channels are read where a channel is one stretch of the file. Raises on unknown or
    repeated channels, on trials whose size doesn't match their time axis, and on a sampling frequency other
    than the expected one.
    """
    with _opened(path) as (labels, trials):
        wanted = channels or labels
        if len(set(wanted)) < len(wanted):
            raise ValueError(f"{path}: channels requested twice")
        missing = [c for c in wanted if c not in labels]
        if missing:
            raise ValueError(f"{path}: no channels {missing}")
        rows, found = [labels.index(c) for c in wanted], list(trials())
        steps = [float(np.median(d[d > 0])) for x in found if (d := np.diff(x.times)).size and (d > 0).any()]
        frequency = 1 / float(np.median(steps)) if steps else None
        if expected_frequency and frequency and abs(frequency - expected_frequency) > FREQUENCY_TOLERANCE:
            raise ValueError(f"{path}: {frequency} Hz instead of {expected_frequency}")
        name, m = parse_name(path), len(wanted)
        for k, trial in enumerate(found):
            n = len(trial.times)
            if not n:
                continue
            if trial.shape not in ((len(labels), n), (n, len(labels))):
                raise ValueError(f"{path}: trial {k} is {trial.shape}, its time axis has {n}")
            data = trial.read(rows, trial.shape == (len(labels), n))
            columns = [*[pa.array([x] * m) for x in name], pa.array([frequency] * m, pa.float64()), pa.array([k] * m, pa.int32()), pa.array(wanted), pa.array([trial.times.astype(float)] * m, pa.list_(pa.float64())), pa.array([np.asarray(d, np.float32) for d in data], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = discover(options["path"], options.get("pattern", "*"))
        self.channels = [c.strip() for c in options["channels"].split(",")] if options.get("channels") else None
        self.expected = float(options["expectedfrequency"]) if options.get("expectedfrequency") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_recording(partition.value, self.channels, self.expected)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)


def discover(folder: str, pattern: str = "*") -> list[str]:
    """Recording files in order; raises if there are none."""
    files = sorted(p for p in glob.glob(os.path.join(folder, pattern)) if p.endswith((".npz", ".mat")))
    if not files:
        raise FileNotFoundError(f"no recordings {pattern} in {folder}")
    return files


def samples(recordings: DataFrame) -> DataFrame:
    """One row per sample: (recording_id, trial, channel, t, value)."""
    pairs = recordings.select("recording_id", "trial", "channel", F.explode(F.arrays_zip("times", "data")).alias("z"))
    return pairs.select("recording_id", "trial", "channel", F.col("z.times").alias("t"), F.col("z.data").alias("value"))


def electrode_mapping(spark: SparkSession, path: str, key: str, label: str) -> DataFrame:
    """CSV mapping (key, label): rows without a key dropped, blanks trimmed; raises on repeated keys."""
    from epochloom.operators.checks import require_unique

    rows = spark.read.csv(path, header=True).select(F.trim(F.col(f"`{key}`")).alias("electrode"), F.trim(F.col(f"`{label}`")).alias("label")).where("electrode IS NOT NULL AND electrode <> ''")
    require_unique(rows, ["electrode"], path)
    return rows


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet or CSV table at a path, or an empty one of the given schema if nothing is there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.parquet(path)


def read_many(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """All Parquet files below a folder whose name ends in ``suffix``, columns united by name."""
    return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)


def ratings_sheet(spark: SparkSession, path: str, subject: str, points: list[str], value: str) -> DataFrame:
    """A wide CSV of ratings, one column per time point, as (subject, timepoint INT, value DOUBLE).

    Cells that aren't numbers are NULL.
    """
    wide = spark.read.csv(path, header=True).select(F.trim(F.col(subject)).alias("subject"), *points)
    number: Column = F.col("cell").try_cast("double")
    return wide.unpivot(["subject"], points, "timepoint", "cell").select("subject", F.col("timepoint").try_cast("int").alias("timepoint"), number.alias(value))

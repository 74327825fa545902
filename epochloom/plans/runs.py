"""Run management on the driver: configuration, immutable runs, resumption, study assembly."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.functions.probability import check_windows
from epochloom.operators.checks import require_unique
from epochloom.session import cut
from epochloom.sources.recordings import path_exists, read_optional
from epochloom.sources.sinks import save_results, write_text

RUN_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


@dataclass(frozen=True)
class AnalysisConfig:
    """Validated settings of an analysis."""

    sampling_frequency: float = 500.0
    epoch_seconds: float = 30.0
    gap_tolerance_seconds: float = 90.0
    windows: dict[str, tuple[float, float]] = field(default_factory=lambda: {"before": (480.0, 840.0), "after": (840.0, 2640.0), "late": (2640.0, 3540.0)})
    least_epochs: int = 1
    analyses: tuple[str, ...] = ()
    stagers: tuple[str, ...] = ()
    output: str = "outputs"

    def __post_init__(self) -> None:
        if self.sampling_frequency <= 0 or self.epoch_seconds <= 0:
            raise ValueError("sampling frequency and epoch length must be positive")
        if self.gap_tolerance_seconds < 0:
            raise ValueError("the gap tolerance can't be negative")
        if self.least_epochs < 1:
            raise ValueError("at least one epoch is needed")
        check_windows(self.windows)


def config_from_mapping(data: dict, base: str = ".") -> AnalysisConfig:
    """Settings from a mapping (YAML or JSON); relative paths hang below ``base``.

    ``least_epochs`` may be given as ``least_minutes``, rounded up to whole epochs.
    """
    known = set(AnalysisConfig.__dataclass_fields__)
    given = dict(data)
    epoch = float(given.get("epoch_seconds", 30.0))
    if "least_minutes" in given:
        given["least_epochs"] = max(1, math.ceil(float(given.pop("least_minutes")) * 60 / epoch))
    unknown = set(given) - known
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    given["windows"] = {k: (float(a), float(b)) for k, (a, b) in given.get("windows", AnalysisConfig().windows).items()}
    for name in ("analyses", "stagers"):
        chosen = given.get(name, ())
        given[name] = tuple(dict.fromkeys(s.lower() for s in ([k for k, on in chosen.items() if on] if isinstance(chosen, dict) else chosen)))
    output = given.get("output", "outputs")
    given["output"] = output if os.path.isabs(output) else os.path.join(base, output)
    return AnalysisConfig(**given)


def config_to_mapping(config: AnalysisConfig) -> dict:
    return asdict(config) | {"windows": {k: list(v) for k, v in config.windows.items()}, "analyses": list(config.analyses), "stagers": list(config.stagers)}


def load_config(path: str) -> AnalysisConfig:
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return config_from_mapping(yaml.safe_load(f), os.path.dirname(path))
        return config_from_mapping(json.load(f), os.path.dirname(path))


def canonical_hash(data: object) -> str:
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def source_hash(folder: str = os.path.dirname(os.path.dirname(__file__))) -> str:
    """Hash over the package's own modules."""
    modules = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.py")}
    return canonical_hash(modules)


def prepare_run(config: AnalysisConfig, name: str, reuse: bool = True) -> str:
    """Create the run's folder with its manifest, or reopen it; raises if settings or code have changed."""
    if not RUN_NAME.match(name):
        raise ValueError(f"not a run name: {name}")
    folder = os.path.join(config.output, name)
    path = os.path.join(folder, "manifest.json")
    mark = {"config_sha256": canonical_hash(config_to_mapping(config)), "source_sha256": source_hash()}
    if os.path.exists(path):
        if not reuse:
            raise FileExistsError(path)
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        changed = [k for k in mark if old.get(k) != mark[k]]
        if changed:
            raise ValueError(f"run {name} was made with other {changed}")
        return folder
    # JSON is YAML, too: the settings as resolved, for reading and for a next run.
    write_text(os.path.join(folder, "config.yaml"), json.dumps(config_to_mapping(config), indent=1, sort_keys=True))
    write_text(path, json.dumps(mark | {"name": name, "status": "started", "config": config_to_mapping(config)}, indent=1, sort_keys=True))
    return folder


def finalize_run(folder: str, summary: DataFrame) -> dict:
    """Record the outcome of a run from its summary (recording, status)."""
    counts = {r["status"]: r["n"] for r in summary.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    path = os.path.join(folder, "manifest.json")
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    manifest |= {"status": "completed" if set(counts) <= {"ok"} else "completed_with_failures", "counts": counts}
    write_text(path, json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def pending(candidates: DataFrame, done: DataFrame, reuse: bool = True) -> DataFrame:
    """Candidates (recording_id, ...) without an 'ok' row in ``done`` (recording_id, status)."""
    return candidates.join(done.where("status = 'ok'").select("recording_id"), "recording_id", "left_anti") if reuse else candidates


def complete(spark: SparkSession, done: DataFrame, folder: str, tables: list[str]) -> DataFrame:
    """The rows of ``done`` (recording_id, status) that are 'ok' and whose recording is in every output table of the folder."""
    kept = done.where("status = 'ok'")
    for name in tables:
        kept = kept.join(read_optional(spark, f"{folder}/{name}.parquet", "recording_id string").select("recording_id").distinct(), "recording_id", "left_semi")
    return kept


def run_batch(spark: SparkSession, candidates: DataFrame, folder: str, tables: list[str], process: Callable[[DataFrame], dict[str, DataFrame]], reuse: bool = True) -> DataFrame:
    """Process the candidates (recording_id, ...) that aren't complete yet; the summary (recording_id, status) of all.

    ``process`` gets the pending candidates and returns the output tables, each with recording_id. A
    recording is 'ok' once it is in every one of ``tables``, else 'failed'. With ``reuse`` recordings that
    are 'ok' in the summary of an earlier call and whose outputs still exist are left alone.
    """
    where = f"{folder}/batch_summary.parquet"
    done = read_optional(spark, where, "recording_id string, status string")
    todo = cut(pending(candidates, complete(spark, done, folder, tables), reuse))
    if not todo.isEmpty():
        save_results({n: df for n, df in process(todo).items() if n in tables}, folder)
    every = candidates.select("recording_id").distinct()
    present = complete(spark, every.withColumn("status", F.lit("ok")), folder, tables)
    summary = cut(every.join(present, "recording_id", "left").na.fill("failed", ["status"]))
    summary.write.mode("overwrite").parquet(where)
    return summary


def tolerance_label(seconds: float) -> str:
    """'090s', '000p5s': a name that sorts like its number."""
    whole, _, rest = f"{seconds:g}".partition(".")
    return f"{int(whole):03d}{'p' + rest if rest else ''}s"


def tolerance_sweep(runs: DataFrame, recording: str, step: float, tolerances: list[float]) -> DataFrame:
    """Blocks per recording under each tolerance, in one job: (recording, tolerance, n_blocks, n_epochs).

    The runs are segmented once; tolerances are an array literal, so rows multiply by their number only.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(recording).orderBy("start_time")
    gap = runs.withColumn("_gap", F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(w) - step))
    each = gap.withColumn("tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    return each.groupBy(recording, "tolerance").agg((F.count(F.when(F.col("_gap") > F.col("tolerance"), 1)) + 1).alias("n_blocks"), F.sum("n_epochs").alias("n_epochs"))


#: Tables of a study with their keys; the optional ones may be absent.
STUDY_KEYS = {
    "features": ["recording_id", "block_id", "epoch", "electrode"],
    "hypnodensities": ["recording_id", "block_id", "epoch", "stager", "channel_set"],
    "blocks": ["recording_id", "block_id"],
    "spectra": ["recording_id", "block_id", "epoch", "electrode", "frequency_hz"],
}
REQUIRED = ("features", "blocks")
#: Further tables of a study, without keys of their own.
OTHERS = {"staging_qc": "recording_id string, block_id string, stager string, status string", "batch_summary": "recording_id string, status string", "file_selection": "recording_id string, selected string"}


def assemble_study(spark: SparkSession, folder: str, strict: bool = True) -> dict[str, DataFrame]:
    """The study's seven tables; absent optional ones are empty. With ``strict``, features and blocks must be there; keys must be
    unique and staged blocks must exist in any case where both tables have rows."""
    absent = [n for n in REQUIRED if not path_exists(spark, f"{folder}/{n}.parquet")]
    if strict and absent:
        raise FileNotFoundError(f"{folder} lacks {absent}")
    tables = {n: read_optional(spark, f"{folder}/{n}.parquet", ", ".join(f"{k} {'int' if k == 'epoch' else 'double' if k == 'frequency_hz' else 'string'}" for k in keys)) for n, keys in STUDY_KEYS.items()}
    tables |= {n: read_optional(spark, f"{folder}/{n}.parquet", schema) for n, schema in OTHERS.items()}
    for name, keys in STUDY_KEYS.items():
        require_unique(tables[name], keys, name)
    if not tables["blocks"].isEmpty():
        lost = tables["hypnodensities"].select("recording_id", "block_id").distinct().join(tables["blocks"], ["recording_id", "block_id"], "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"staged blocks that don't exist: {[tuple(r) for r in lost]}")
    return tables

import hashlib
import json
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.functions import probability
from epochloom.operators import checks, reshape, windows
from epochloom.plans import runs
from epochloom.sources import recordings, sinks


@pytest.fixture
def folder(tmp_path):
    t = np.arange(50) / 10
    for name, flip in (("X_P07D1_inner", False), ("X_P07D5_inner", True)):
        a, b = np.stack([np.full(50, 10.0 * c) for c in range(3)]), np.ones((3, 50))
        np.savez(tmp_path / f"{name}.npz", label=np.array(["E1", "E9", "E45"]), trial_0=a.T if flip else a, time_0=t, trial_1=b.T if flip else b, time_1=t + 60, trial_2=np.zeros((3, 0)), time_2=np.zeros(0))
    return str(tmp_path)


def test_recording_source(spark, folder):
    recordings.register(spark)
    df = spark.read.format("recording").option("channels", "E45,E1").load(folder)
    rows = df.collect()
    assert len(rows) == 8 and {r["condition"] for r in rows} == {"placebo", "DMT"} and {r["channel"] for r in rows} == {"E45", "E1"}
    assert all(r["data"][0] == 20.0 for r in rows if r["channel"] == "E45" and r["trial"] == 0)
    assert rows[0]["sampling_frequency"] == pytest.approx(10.0)
    assert recordings.samples(df).count() == 400
    assert recordings.read_channels(recordings.discover(folder)[0]) == ["E1", "E9", "E45"]
    with pytest.raises(ValueError, match="no channels"):
        list(recordings.read_recording(recordings.discover(folder)[0], ["E2"]))
    with pytest.raises(ValueError, match="Hz"):
        list(recordings.read_recording(recordings.discover(folder)[0], None, 500.0))
    with pytest.raises(FileNotFoundError):
        recordings.discover(folder, "nothing*")
    assert recordings.decode_label("E1\x00\x00".encode("utf-16-le")) == "E1"


def test_csv_sources(spark, tmp_path):
    path = str(tmp_path / "map.csv")
    sinks.write_text(path, "EGI Label,10-20 Label\n E1 ,Fz\n,Cz\nE2, Pz\n")
    assert sorted(map(tuple, recordings.electrode_mapping(spark, path, "EGI Label", "10-20 Label").collect())) == [("E1", "Fz"), ("E2", "Pz")]
    sinks.write_text(path, "EGI Label,10-20 Label\nE1,Fz\nE1,Cz\n")
    with pytest.raises(ValueError, match="share a key"):
        recordings.electrode_mapping(spark, path, "EGI Label", "10-20 Label")
    sinks.write_text(path, "id,1,2\nP1,3,x\nP2,,4.5\n")
    got = sorted(map(tuple, recordings.ratings_sheet(spark, path, "id", ["1", "2"], "intensity").where("intensity IS NOT NULL").collect()))
    assert got == [("P1", 1, 3.0), ("P2", 2, 4.5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "recording_id string, x int")
    for suffix in (".parquet", ".csv", ".json"):
        sinks.save_table(df, str(tmp_path / f"t{suffix}"), single_file=True)
    with pytest.raises(ValueError):
        sinks.save_table(df, str(tmp_path / "t.xlsx"))
    out = str(tmp_path / "out")
    assert set(sinks.save_results({"features": df, "spectra": df.limit(0)}, out)) == {"features"}
    sinks.save_results({"features": df.where("x = 2").withColumn("x", F.lit(7))}, out)
    assert sorted((r["recording_id"], r["x"]) for r in spark.read.parquet(f"{out}/features.parquet").collect()) == [("a", 1), ("b", 7)]
    assert recordings.read_many(spark, out, ".parquet").count() == 2
    assert recordings.read_optional(spark, f"{out}/none.parquet", "a string").count() == 0
    path = sinks.write_status(out, "a", {"status": "ok"})
    got = sinks.inventory(spark, f"{out}/_status").first()
    assert got["sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest() and got["file"] == "a.json"


def test_runs(spark, tmp_path):
    config = runs.config_from_mapping({"output": "o", "least_minutes": 1.2, "stagers": {"GSSC": True, "yasa": False}, "windows": {"a": [0, 5]}}, str(tmp_path))
    assert config.least_epochs == 3 and config.stagers == ("gssc",) and config.windows == {"a": (0.0, 5.0)}
    assert runs.config_from_mapping(runs.config_to_mapping(config)) == config
    folder = runs.prepare_run(config, "first")
    assert runs.prepare_run(config, "first") == folder
    with pytest.raises(ValueError, match="other"):
        runs.prepare_run(runs.config_from_mapping(runs.config_to_mapping(config) | {"gap_tolerance_seconds": 5}), "first")
    with pytest.raises(ValueError):
        runs.prepare_run(config, "../x")
    done = spark.createDataFrame([("a", "ok"), ("b", "failed")], "recording_id string, status string")
    assert runs.finalize_run(folder, done)["status"] == "completed_with_failures"
    assert json.load(open(f"{folder}/manifest.json"))["counts"] == {"ok": 1, "failed": 1}
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "recording_id string")
    assert sorted(r[0] for r in runs.pending(todo, done).collect()) == ["b", "c"] and runs.pending(todo, done, reuse=False).count() == 3
    assert [runs.tolerance_label(x) for x in (0, 90, 0.5)] == ["000s", "090s", "000p5s"]
    for bad in ({"windows": {"a": [5, 1]}}, {"gap_tolerance_seconds": -1}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            runs.config_from_mapping(bad)


def test_assembly(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("r", "b", 0, "gssc", "E1")], "recording_id string, block_id string, epoch int, stager string, channel_set string").write.parquet(f"{folder}/hypnodensities.parquet")
    with pytest.raises(FileNotFoundError, match="features"):
        runs.assemble_study(spark, folder)
    assert runs.assemble_study(spark, folder, strict=False)["blocks"].count() == 0
    spark.createDataFrame([("r", "b", 0, "E1")], "recording_id string, block_id string, epoch int, electrode string").write.parquet(f"{folder}/features.parquet")
    blocks = lambda name: spark.createDataFrame([("r", name)], "recording_id string, block_id string").write.mode("overwrite").parquet(f"{folder}/blocks.parquet")
    blocks("other")
    with pytest.raises(ValueError, match="don't exist"):
        runs.assemble_study(spark, folder)
    blocks("b")
    tables = runs.assemble_study(spark, folder)
    assert len(tables) == 7 and tables["hypnodensities"].count() == 1 and tables["spectra"].count() == 0 == tables["file_selection"].count()
    spark.createDataFrame([("r", "b", 0, "E1")] * 2, "recording_id string, block_id string, epoch int, electrode string").write.mode("overwrite").parquet(f"{folder}/features.parquet")
    with pytest.raises(ValueError, match="share a key"):
        runs.assemble_study(spark, folder, strict=False)


def test_only_requested_channels_are_read(folder, monkeypatch):
    path = recordings.discover(folder)[0]  # channels first, stored: a channel is one stretch of the file
    read = []
    original = zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: read.append((self.name, len(data := original(self, n)))) or data)
    assert recordings.read_channels(path) == ["E1", "E9", "E45"] and {name for name, _ in read} == {"label.npy"}
    read.clear()
    (one, two) = recordings.read_recording(path, ["E45"])
    assert one.num_rows == 1 and one.column("data")[0].as_py() == [20.0] * 50 and two.column("trial")[0].as_py() == 1
    assert sum(n for name, n in read if name == "trial_0.npy") < 3 * 50 * 8


def test_batches_resume_where_outputs_are_missing(spark, tmp_path):
    folder, seen = str(tmp_path / "out"), []
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "recording_id string")

    def process(todo):
        ids = sorted(r[0] for r in todo.collect())
        seen.append(ids)
        every = todo.select("recording_id").withColumn("x", F.lit(1))
        return {"features": every, "blocks": every.where("recording_id <> 'c' OR 1 = %d" % (len(seen) > 2)), "unasked": every}

    run = lambda **more: {r["recording_id"]: r["status"] for r in runs.run_batch(spark, candidates, folder, ["features", "blocks"], process, **more).collect()}
    assert run() == {"a": "ok", "b": "ok", "c": "failed"} and seen == [["a", "b", "c"]]
    shutil.rmtree(f"{folder}/features.parquet/recording_id=b")
    assert run() == {"a": "ok", "b": "ok", "c": "failed"} and seen[1] == ["b", "c"]
    assert run() == {"a": "ok", "b": "ok", "c": "ok"} and seen[2] == ["c"]
    assert run() == {"a": "ok", "b": "ok", "c": "ok"} and len(seen) == 3
    run(reuse=False)
    assert seen[3] == ["a", "b", "c"]


def test_packs_need_the_same_recordings(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,) for x in ids], "recording_id string") for ids in ("ab", "abc"))
    with pytest.raises(ValueError, match="right"):
        sinks.export_pack(spark, {"features": a, "spectra": b}, str(tmp_path))
    rows = spark.read.json(sinks.export_pack(spark, {"features": a, "spectra": a}, str(tmp_path))).collect()
    assert rows and all(len(r["sha256"]) == 64 and r["n_bytes"] > 0 for r in rows)


def test_reshape_and_contracts(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None), ("b", "z", 9.0)], "k string, c string, v double")
    assert sorted(map(tuple, reshape.pivot_unique(df, ["k"], "c", ["x", "y"], "v").collect())) == [("a", 1.0, 2.0), ("b", None, None)]
    with pytest.raises(ValueError, match="share a key"):
        reshape.pivot_unique(df.unionByName(df), ["k"], "c", ["x"], "v")
    assert sorted(map(tuple, reshape.pivot_cells(df.na.fill(0), ["k"], "c", ["x", "y"], "<%.1f>", F.col("v")).collect())) == [("a", "<1.0>", "<2.0>"), ("b", "<0.0>", "")]
    assert reshape.columns_by_suffix(df, ["k"], ("v",), "n_").columns == ["k", "n_v"]
    with pytest.raises(ValueError, match="no column"):
        reshape.columns_by_suffix(df, ["k"], ("q",), "n_")
    checks.require_same_keys(df, df, "k")
    with pytest.raises(ValueError, match="left"):
        checks.require_same_keys(df, df.where("k = 'a'"), "k")
    five = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4, 0.0]), (2, [0.1]), (3, None)], "i int, p array<double>")
    assert [tuple(r)[1:] for r in probability.probability_array(five, "p").orderBy("i").collect()] == [(0.1, 0.2, 0.3, 0.4, 0.0), (None,) * 5, (None,) * 5]
    with pytest.raises(Exception, match="not a probability"):
        df.select(probability.logit(F.col("v"), strict=True)).collect()
    jitter = [r[0] for r in spark.range(500).select(windows.seeded_offsets(F.col("id"), 3)).collect()]
    assert -0.5 <= min(jitter) < -0.45 and 0.45 < max(jitter) < 0.5 and len(set(jitter)) > 490

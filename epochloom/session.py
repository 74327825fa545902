"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("epochloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder that all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only a session in one process (``local[n]``, as in
    tests) gets a folder of its own where none is named; on a cluster that would be a folder of the
    driver's machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="epochloom-ck-"))
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; reliable checkpoints survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

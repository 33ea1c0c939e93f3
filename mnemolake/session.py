"""Session settings and the reliable-checkpoint helper."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(
    cores: int | None = None, app: str = "mnemolake", memory: str = "12g", settings: dict[str, str] | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Executors on other machines cannot see a temporary folder of this one, so only a local session that names
    none gets one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        require_local(context.master)
        folder = tempfile.mkdtemp(prefix="mnemolake-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def require_local(master: str) -> None:
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def run_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the shared folder for one run's files; it lasts as long as the application."""
    root = f"{shared_folder(spark)}/runs-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove_at_exit, spark)
    return f"{root}/run-{uuid.uuid4().hex}"


#: Names only: functions sent to executors carry this module, and a session cannot travel.
_roots: set[str] = set()


def _remove_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        remove_run_files(spark)


def remove_run_files(spark: SparkSession) -> None:
    """Delete the files of this application's runs; results that still read them must be written first."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    root = f"{shared_folder(spark)}/runs-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _roots.discard(root)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

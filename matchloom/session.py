"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.files import Files

#: Spark's setting that shuffle files go as soon as the job that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster bring your own."""
    parts = str(shuffle_partitions or cpus).replace("*", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchloom")
        .config("spark.driver.memory", os.environ.get("MATCHLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL_ROOT: list[str] = []  # one temporary root per local driver process


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder the cluster names.

    Only a local session may fall back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="matchloom-"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage after costly or non-deterministic steps (model calls); a lost executor
    re-reads files instead of calling the model again. The shuffle files of the write go with its end, for
    what reads the result reads the folder. ``discard`` removes the folder.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Remove the folders of results of ``materialise``, once all that was made from them is written itself."""
    for df in written:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            Files(df.sparkSession, folder).delete_uri(folder)

"""Session defaults and the lineage-cutting helper."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "docspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect; ``conf`` overrides them.

    Partition counts are left to the cluster (AQE coalesces them); only semantics
    that change results (time zone) and adaptive execution are pinned. Sort-merge joins become
    hash joins at run time only where every build partition was measured to be small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, one sub-folder per application.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local one is chosen only in
    local mode (tests); on a cluster an unset folder is an error, because lost executors
    could not recover from it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/docspark/{context.applicationId}"


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="docspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several branches of a plan: the branches then share the
    table instead of recomputing it, the planner knows its size, and a lost executor costs
    nothing upstream.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session settings and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trajlens", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.windowExec.buffer.in.memory.threshold", "65536")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        # Local tables are far below the target partition size, so keep one partition per core.
        builder = builder.master(master).config(
            "spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8")
        ).config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.driver.memory", "12g")
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="trajlens-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

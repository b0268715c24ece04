"""What the operators of this package share: reading, hold-out, shared folders and worker memory."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learnt from; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % FOLDS == 0, F.lit(False))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="trajlens-shared-")
    return f"{str(root).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as the Python worker works for one purpose, so that its tasks share what it holds.

    A task for another purpose starts a new one and lets the old one go: a worker
    that serves several stages in turn holds one stage's words at a time.
    """
    home = sys.modules.setdefault("_trajlens_worker_memory", types.ModuleType("_trajlens_worker_memory"))
    held = home.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def quiet_tokenizers() -> None:
    """One thread for each task: the other cores belong to other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"

"""Sources and sinks of the streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for stream state and output below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="trajlens-stream-")
    return f"{root}/{uuid.uuid4().hex}"


def read_json(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Session files as a stream: new files are picked up as they arrive."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true").json(folder))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder as a stream: a folder of part files or a single file."""
    table = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(table)
    # A stream reads folders, so a single file is picked by its name.
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def read_parts(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet part files as a stream."""
    stream = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream).parquet(folder)


def to_table(stream: DataFrame) -> DataFrame:
    """Run an append-only stream over what is there now and return its output as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option(
        "path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def to_latest(stream: DataFrame) -> DataFrame:
    """Run an aggregating stream over what is there now and return its final state."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(
        availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{folder}/out")
    last = every.selectExpr("max(batch)").first()[0]
    return every.where(every.batch == last).drop("batch")


def on_anomaly(stream: DataFrame, act: Callable[[DataFrame], None]):
    """Hand every micro-batch of anomalies to ``act``."""
    spark = stream.sparkSession
    return stream.writeStream.outputMode("append").option("checkpointLocation", f"{shared_folder(spark)}/state").foreachBatch(
        lambda batch, _: act(batch)).start()

"""Discovery and incremental archiving of session files, as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_NAME = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.jsonl$"


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every line of every session file below ``root`` with its file and parsed time."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root).withColumn("file", F.col("_metadata.file_path"))
    return lines.where(F.col("file").rlike(SESSION_NAME) & (F.trim("value") != "")).select(
        "file", "value", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("ts"))


def discover(lines: DataFrame, key: str, ts: str, min_lines: int) -> DataFrame:
    """Sessions of at least ``min_lines`` lines with their first and last time, newest first."""
    return lines.groupBy(key).agg(F.count("*").alias("lines"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).where(
        F.col("lines") >= min_lines).orderBy(F.desc("last_ts"), key)


def archive_actions(source: DataFrame, kept: DataFrame) -> DataFrame:
    """What archiving does per file: copy new and grown files, never replace by a smaller one."""
    joined = source.withColumnRenamed("bytes", "_src").join(kept.withColumnRenamed("bytes", "_kept"), "name", "full_outer")
    action = (F.when(F.col("_src").isNull(), "kept").when(F.col("_kept").isNull(), "new")
              .when(F.col("_src") > F.col("_kept"), "grew").otherwise("unchanged"))
    return joined.select("name", action.alias("action"), F.greatest("_src", "_kept").alias("bytes"))

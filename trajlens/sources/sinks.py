"""Writers of feature tables, ledgers and fitted baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajlens.operators.labels import latest


def write_features(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Ledger rows are only ever added; a newer row of a key replaces it on reading."""
    rows.write.mode("append").json(path)


def read_latest(spark: SparkSession, path: str, schema: str, keys: list[str], *order: str) -> DataFrame:
    """The newest row per key of an append-only ledger."""
    return latest(spark.read.schema(schema).json(path), keys, *order)


PROFILE = ("phase_distributions", "transition_model", "tool_shares", "bigram_shares")


def save_profile(path: str, **tables: DataFrame) -> None:
    """The fitted baselines, one table each."""
    unknown = set(tables) - set(PROFILE)
    if unknown:
        raise ValueError(f"not part of a profile: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_profile(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names or PROFILE}

"""Token counts by a digest cache: only texts whose digest the cache lacks are encoded, and then stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.llm.wordpieces import byte_counts
from trajlens.session import durable

CACHE_DDL = "digest binary, version binary, n_tokens long"
TEXTS = 256


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file: another vocabulary or another rule is another version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def unchanged(text: Column) -> Column:
    return text


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; an empty table where the folder has none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_DDL)
    return spark.read.schema(CACHE_DDL).parquet(folder)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, normalise: Callable[[Column], Column] = unchanged,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: ``doc_id, n_bytes, n_tokens``.

    Null texts count as empty ones and have 0 tokens. Equal texts are encoded
    once, whichever of the rows holding them comes first; each row keeps its
    own result row. Null ids stay null, an empty table gives no rows, and other
    columns are not read. ``normalise`` is applied before a text is digested
    and encoded; by default texts are taken as they are. ``cache`` is a folder
    that all executors share. What was missing is appended to it, so a later
    call with the same texts encodes none. A task that runs again writes the
    same counts; rows stored twice are read once.
    """
    spark = docs.sparkSession
    version = F.unhex(F.lit(tokenizer_version(tokenizer)))
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # A digest of 32 bytes stands for the text, so equal digests are equal texts.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))

    def counts() -> DataFrame:
        return read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()   # rows that repeat an id and its text come to one task
        for batch in batches:
            new = [d not in seen and not seen.add(d) for d in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                n = byte_counts(tokenizer, some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    # Copies meet as digests only; of each missing text, one row is chosen and only those texts move.
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    missing = (texts.groupBy("digest").agg(F.min("doc_id").alias("first"))
               .join(counts().select("digest"), "digest", "left_anti").withColumnRenamed("digest", "missing"))
    chosen = (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first"))
    fresh = texts.join(missing.hint("shuffle_hash"), chosen, "left_semi").select("digest", "text")
    (fresh.mapInArrow(encode, "digest binary, n_tokens long")
     .select("digest", version.alias("version"), "n_tokens").write.mode("append").parquet(cache))
    # Written before the join, so that Spark can split the many rows of one digest over tasks.
    # Left, so that a row can never get lost between the two reads.
    return rows.join(durable(counts()), "digest", "left").select("doc_id", "n_bytes", "n_tokens")

"""Token counts with a digest cache.

Contents are named by the digest of their normalised text, tokenizers by the digest of their file.
Stored counts are joined by both; only distinct contents without one are encoded, and their counts
are appended to the cache, a Parquet table that Spark commits whole, so a lost executor or a
second run at the same time can add a row twice but never a wrong one.

Normalising must not change a count, so the default only makes null an empty text.

Defined results: null counts as empty; repeated rows are counted each and encoded once; an empty
table gives an empty table and an empty cache; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import tokenizer, version

CACHE = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts, one row for each content and tokenizer; none if nothing was stored yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.groupBy("digest", "tokenizer").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, id_column: str = "doc_id", text_column: str = "text", normalised: Column | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs; what is missing in the cache is encoded and appended first."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    content = text if normalised is None else F.coalesce(normalised, F.lit(""))
    named = docs.select(F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    which = version(tokenizer_path)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == which)

    # the first of equal contents is chosen before the shuffle as well as after it: a third of all rows may be one text
    distinct = named.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = tokenizer(tokenizer_path).count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([which] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == which).select("digest", "n_tokens")
    return named.drop("content").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

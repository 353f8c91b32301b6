"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

All stages take any rows: null texts count as empty (quality rules reject them), very long texts are read whole, repeated rows
and ties are settled as each operator says, empty tables give empty tables of the same columns, and columns that are not the
stage's own are carried along under any name, but for the last stage, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, lines, packing, quality_rules, simhash
from tracemill.llm.common import new_folder, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own rules and whose host pass. Null and short texts fail; null hosts are one host; repeated rows are judged each."""
    return quality_rules.quality_rules(docs, docs.columns).filter("__rules.kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with one line of each group of near-equal lines left; n_chars is counted anew. The line of the least id stays; of
    repeated rows all but one lose their lines; null texts stay null."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the least id, of repeated rows the first stored. Documents without words are one
    component."""
    return simhash.without_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and short texts hold none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset. A null text has only its end token; ties of length are ranked by id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", filter_quality), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("decontamination", remove_benchmark), ("packing", pack)]

#: MinHash banding and tokenizers are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

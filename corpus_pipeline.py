"""A corpus pipeline of five operators of ``unifold.llm``, each stage written as Parquet and read again.

Toxic documents go; repeated lines are cut from the texts; of each group of near
duplicates the document of the least id stays; documents with a benchmark
passage go; what is left is encoded. Documents whose lines were all cut stay, with
an empty text. Repeated rows (equal id and text) count as near duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unifold.llm import decontaminate, jaccard, lines, storage, tokens, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut all but the first occurrence of equal and nearly equal lines; ``n_chars``, if there is one, follows."""
    out = lines.dedup(docs).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id (nulls last), of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text: ids (binary, little-endian unsigned 32-bit), their number, and the text they decode to."""
    out = tokens.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("bpe", encoded)]

#: SQL can't express learned scores, SimHash groups or tokenizer merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, in five stages.

Every stage gets what its predecessor kept, written as Parquet and read again, and decides
on that alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.decontaminate import without_benchmark
from planmatch.llm.packing import pack
from planmatch.llm.queries import held_out
from planmatch.llm.simhash import one_of_each
from planmatch.llm.suffix_dedup import repeated_passages
from planmatch.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from planmatch.sources.storage import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), keep=COLUMNS)
    return scored.where(F.col("score") < THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id:
    fingerprints of three-word shingles that differ in three bits at most."""
    return one_of_each(docs, COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out; a document that is all repeats goes. A
    character that is cut in part goes as a whole."""
    cleaned = repeated_passages(docs, keep=("text", "lang", "source", "n_chars"), as_text=True)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("rest")).otherwise(F.col("text"))
    kept = cleaned.where(~cut | (F.length(text) > 0)).withColumn("text", text)
    chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the fingerprints and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

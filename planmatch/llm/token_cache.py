"""Token counts with a digest cache.

A text is normalised in a way that cannot change its tokens, and named by the digest of the
result. Counts are kept in a table under (content digest, tokenizer digest). A run joins its
distinct digests to the stored counts, encodes the distinct misses only, appends them, and
reads every count from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, utf8
from planmatch.llm.tokens import PieceEncoder, tokenizer_digest
from planmatch.operators.joins import join_back
from planmatch.sources.storage import materialise, scratch_path

CACHE = "digest string, tokenizer string, n_tokens bigint"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one blank, outer ones go; null is empty.

    The tokenizer drops white space and never merges across it, so this keeps the ids.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) kept for one tokenizer; a digest that two runs appended counts once."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE)
    mine = table.where(F.col("tokenizer") == tokenizer)
    return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, digest, n_tokens) for every row, repeats included.

    `tokenizer` is the path of the file, `cache` that of the table of counts, in a folder
    all executors share; without one a table for this run is made. Null texts are empty: 0
    bytes, 0 tokens. Copies of a text, and texts that differ in white space only, are
    encoded once however many rows hold them.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or scratch_path(spark, "token-counts")
    clean = normalised(named(text))
    rows = materialise(
        docs.select(
            named(doc_id).alias("doc_id"),
            F.octet_length(F.coalesce(named(text), F.lit(""))).cast("long").alias("n_bytes"),
            F.sha2(clean, 256).alias("digest"),
        ),
        "digests",
    )
    distinct = rows.groupBy("digest").agg(F.count("*").alias("n"))
    misses = materialise(
        distinct.select("digest").join(stored_counts(spark, cache, version), "digest", "left_anti"), "misses"
    )
    # One text per digest: copies fall together before the exchange as well as after it.
    texts = docs.select(F.sha2(clean, 256).alias("digest"), clean.alias("text")).dropDuplicates(["digest"])
    fresh = texts.join(misses, "digest", "left_semi")

    def encode(batch):
        encoder = PieceEncoder.of(tokenizer)
        counts = [len(encoder.encode(raw)) // 2 for raw in utf8(batch.column(1))]
        return [batch.column(0), [version] * len(counts), counts]

    arrow_map(fresh, encode, CACHE).write.mode("append").parquet(cache)
    keyed = distinct.join(stored_counts(spark, cache, version), "digest")
    return join_back(rows, keyed, ["digest"], ["doc_id"])

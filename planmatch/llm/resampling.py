"""Importance resampling towards a target distribution, by bit-sliced sums.

A text's features (runs of words) are counted in hashed buckets. Counts over all documents
and over the target texts give each bucket a gain, a whole number; a document's weight is
the mean gain of its features. To add up count x gain over all buckets, both are sliced
into bits: plane k of a document is the bitmap of the buckets whose count has bit k, plane
j of the gains that of the buckets whose gain, positive or negative, has bit j. The sum is
that of 2^(k+j) x popcount(plane k AND plane j), exact whatever the counts.

The draw is a top-k by score (weight plus noise that the id fixes). Scored rows are dealt
into ranges, and the rows of the ranges before give every range its first rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, utf8
from planmatch.llm.decontaminate import words_of
from planmatch.sources.storage import materialise

BUCKETS = 10_000
LONGEST_RUN = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Features that are held at once while a text is counted.
CHUNK = 1 << 16


def text_counts(raw: bytes, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[int, int, np.ndarray]:
    """(words, features, counts per bucket) of a text. A feature is a run of 1 to `longest`
    consecutive words joined by one space; its bucket is its CRC-32 modulo `buckets`."""
    words = words_of(raw)
    counts = np.zeros(buckets, np.int64)
    features = 0
    # CRC-32 goes on from the run without its last word.
    spaced = [b" " + w for w in words]
    sums = list(map(zlib.crc32, words))
    for length in range(1, longest + 1):
        if len(sums) == 0:
            break
        features += len(sums)
        for at in range(0, len(sums), CHUNK):
            part = np.array(sums[at : at + CHUNK], np.int64) % buckets
            counts += np.bincount(part, minlength=buckets)
        sums = list(map(zlib.crc32, spaced[length:], sums))
    return len(words), features, counts


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, words of 64): plane k is the bitmap of the values that have bit k; no plane
    where all are zero."""
    most = int(values.max()) if len(values) else 0
    bits = np.arange(most.bit_length())[:, None]
    packed = np.packbits((values[None, :] >> bits & 1).astype(np.uint8), axis=1)
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)


class GainPlanes:
    """Signed whole numbers per bucket, sliced into bits."""

    def __init__(self, gains: np.ndarray):
        self.planes = [(1, bit_planes(np.maximum(gains, 0))), (-1, bit_planes(np.maximum(-gains, 0)))]

    def dot(self, counts: np.ndarray) -> int:
        """Sum of count x gain, exact."""
        total = 0
        sliced = bit_planes(counts)
        for sign, planes in self.planes:
            if not len(planes):
                continue
            for k, plane in enumerate(sliced):
                met = np.bitwise_count(planes & plane).sum(axis=1, dtype=np.int64)
                total += sign * sum(int(n) << (k + j) for j, n in enumerate(met))
        return total


def bucket_totals(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Features per bucket over all rows; tasks hand on one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in utf8(batch.column(0)):
                total += text_counts(raw, buckets, longest)[2]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"]
        )

    counted = texts.select(named(text)).mapInArrow(count, "bucket int, n bigint")
    totals = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        totals[r["bucket"]] = r["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) per bucket, in doubles."""
    buckets = len(corpus)
    whole, aim = int(corpus.sum()) + buckets, int(target.sum()) + buckets
    return np.array(
        [math.floor(1000 * math.log((int(t) + 1) * whole / ((int(s) + 1) * aim))) for s, t in zip(corpus, target)],
        np.int64,
    )


def weights(
    docs: DataFrame, gains: np.ndarray, keep: Sequence[str] = ("doc_id",), text: str = "text",
    longest: int = LONGEST_RUN,
) -> DataFrame:
    """The kept columns as k0, k1, ... with n_words, n_features and the weight of every row."""
    planes, buckets = GainPlanes(gains), len(gains)
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def weigh(batch):
        words, features, mean = [], [], []
        for raw in utf8(batch.column(len(keep))):
            n_words, n_features, counts = text_counts(raw, buckets, longest)
            words.append(n_words)
            features.append(n_features)
            mean.append(planes.dot(counts) // n_features if n_features else 0)
        return [*batch.columns[: len(keep)], words, features, mean]

    used = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).alias("text"))
    return arrow_map(used, weigh, f"{kinds}, n_words bigint, n_features bigint, weight bigint")


def id_noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u in (0, 1) that seed and id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`rows` (a written table) with their global `place` from 1 under `order`, which
    should tell all rows apart: equal rows share a range."""
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("rows")).select(  # one row per range
        "part", F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("below")
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(F.broadcast(starts), "part")
    return placed.withColumn("place", F.row_number().over(inside) + F.col("below")).drop("part", "below")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs`.

    Of the rows with at least `least_words` words, floor(percent x rows / 100) are drawn:
    those of the highest scores, rank 1 first, ties to the smaller id (none last). Others
    have no rank. Null texts have no words and weight 0; a null id has the noise of an
    empty one. Repeated rows take part each for itself, in an order that their words,
    features and weights settle and that is open only among equals. An empty target leaves
    the corpus alone to set the gains; an empty table gives no rows. Only `doc_id` and the
    text are read, so other columns may have any name.
    """
    corpus = bucket_totals(docs, text, buckets, longest)
    gains = bucket_gains(corpus, bucket_totals(target, target_text, buckets, longest))
    weighed = weights(docs, gains, [doc_id], text, longest).withColumnRenamed("k0", "doc_id")
    score = F.col("weight") + id_noise(F.col("doc_id"), seed)
    # The scan's row number tells repeated rows apart, so that no range grows with them.
    scored = materialise(
        weighed.withColumn("score", score.cast("bigint")).withColumn("scan", F.monotonically_increasing_id()), "scored"
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = eligible.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("n_features"), F.asc("weight"), F.asc("scan")]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = ranked(eligible, order).select(
        *columns, F.when(F.col("place") <= wanted, F.col("place").cast("bigint")).alias("rank")
    )
    short = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(short)

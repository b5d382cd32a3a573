"""Toxicity score of texts: a linear classifier over character n-grams, every feature
scaled by its naive Bayes log-count ratio.

n-grams of code points (A-Z folded) are hashed into a fixed number of buckets and count
once per text. On labelled texts the ratio of a bucket is log of its smoothed share among
toxic texts over its share among the others. Buckets that do not tell the classes apart
are left out, unless none does; a logistic regression is fitted on the others times their ratios. Weights and ratios fold into one vector of BUCKETS numbers,
which is all that travels to the scoring pass.

Fitting uses at most `train_rows` labelled rows, those with the smallest hash of the id;
scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from planmatch.functions.predicates import named
from planmatch.llm.batches import LOWER, arrow_map, kept_fields, utf8
from planmatch.sources.storage import materialise

BUCKETS = 1 << 18
LENGTHS = (4, 5)
TRAIN_ROWS = 16_000
# Code points looked at together; a longer text goes through in overlapping pieces.
PIECE = 1 << 20
SMOOTH = 20.0
SURE = 3.5
REG = 0.001
# Feature vectors in one Arrow batch.
VECTORS = 200
THRESHOLD = 0.3


def _buckets(raw: bytes) -> list[np.ndarray]:
    """Hashed n-grams of a text, piece by piece; a bucket may come up more than once."""
    points = np.frombuffer(
        raw.translate(LOWER).decode("utf-8", "replace").encode("utf-32-le"), np.uint32
    )
    padded = np.empty(len(points) + 2, np.uint64)
    padded[1:-1] = points
    padded[0] = padded[-1] = 32
    out = []
    overlap = max(LENGTHS) - 1
    for begin in range(0, len(padded), PIECE):
        piece = padded[begin : begin + PIECE + overlap]
        rolled = np.zeros(len(piece), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if len(piece) < n:
                break
            rolled = rolled[: len(piece) - n + 1] * np.uint64(0x100000001B3) + piece[n - 1 :]
            if n in LENGTHS:
                mixed = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                out.append((mixed >> np.uint64(46)).astype(np.int64))
    return out


class _Distinct:
    """Buckets of a text, each once, without sorting: every entry writes its number into
    its bucket, and the one that is still found there afterwards stands for the bucket."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int64)

    def __call__(self, raw: bytes) -> np.ndarray:
        parts = _buckets(raw)
        met = np.concatenate(parts) if parts else np.empty(0, np.int64)
        numbers = np.arange(len(met))
        self.last[met] = numbers
        return met[self.last[met] == numbers]


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        distinct = _Distinct()
        sums = np.array([self.weights[distinct(t)].sum(dtype="float64") for t in texts])
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -500, 500)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Learn from the labelled rows that are handed in; callers keep test rows away.

    Rows without id, or with a label other than 0 and 1, teach nothing. A repeated id is
    joined as it stands. With one class alone, or no rows, every score is that class's
    share (0 without rows).
    """
    marked = (
        labels.where(named(label).isin(0, 1) & named(doc_id).isNotNull())
        .select(named(doc_id).alias("id"), named(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(train_rows)
    )
    texts = docs.select(named(doc_id).alias("id"), named(text).alias("text"))
    # At most train_rows rows of an id and a number.
    chosen = texts.join(F.broadcast(materialise(marked, "labels")), "id")

    def featurise(batches):
        distinct = _Distinct()
        for whole in batches:
            for begin in range(0, whole.num_rows, VECTORS):
                batch = whole.slice(begin, VECTORS)
                met = [np.sort(distinct(t)).astype(np.int32) for t in utf8(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(met, pa.list_(pa.int32()))], names=["label", "buckets"]
                )

    features = materialise(
        chosen.select("label", "text").mapInArrow(featurise, "label double, buckets array<int>"), "toxicity"
    )
    shares = {r["label"]: r["n"] for r in features.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = shares.get(1.0, 0), shares.get(0.0, 0)
    if not toxic or not other:
        sure = 0.0 if not toxic else 1.0
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 500.0 if sure else -500.0)

    # One row per bucket: bounded by BUCKETS.
    counts = (
        features.select("label", F.explode("buckets").alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
        .toPandas()
    )
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    p[counts["bucket"]] = counts["p"]
    q[counts["bucket"]] = counts["q"]
    ratios, telling = log_count_ratios(p, q, toxic, other)
    if not len(telling):  # too few rows for any bucket to be sure: all that were met
        telling = np.flatnonzero(p + q)
    if not len(telling):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(toxic / other)))
    place = np.full(BUCKETS, -1, np.int32)
    place[telling] = np.arange(len(telling))
    scale = ratios[telling]

    pair = T.StructType(
        [T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]
    )
    arrow = to_arrow_schema(pair)

    def scaled(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, VECTORS):
                batch = whole.slice(begin, VECTORS)
                met = place[batch.column(1).flatten().to_numpy()]
                row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
                lengths = np.bincount(row[met >= 0], minlength=batch.num_rows)
                ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
                met = met[met >= 0]
                kind = arrow.field(1).type
                parts = [
                    pa.array(np.zeros(len(lengths)), pa.int8()),
                    pa.array(np.full(len(lengths), len(telling)), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(met, pa.int32()), type=kind.field(2).type),
                    pa.ListArray.from_arrays(ends, pa.array(scale[met]), type=kind.field(3).type),
                ]
                vectors = pa.StructArray.from_arrays(parts, fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], schema=arrow)

    known = features.mapInArrow(scaled, pair)
    fitted = LogisticRegression(maxIter=100, regParam=REG, standardization=False).fit(known)
    weights = np.zeros(BUCKETS, np.float32)
    weights[telling] = fitted.coefficients.toArray() * scale
    return ToxicityModel(weights, float(fitted.intercept))


def log_count_ratios(p: np.ndarray, q: np.ndarray, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of every bucket, smoothed by SMOOTH rows of the usual mix,
    and the buckets that tell the classes apart: their toxic rows are SURE standard
    deviations away from what their rows would hold by chance."""
    share = toxic / (toxic + other)
    ratios = np.log((p + SMOOTH * share) / (toxic + SMOOTH * share)) - np.log(
        (q + SMOOTH * (1 - share)) / (other + SMOOTH * (1 - share))
    )
    chance = (p + q) * share
    off = np.abs(p - chance) / np.sqrt(np.maximum(chance, 1e-9) * (1 - share))
    return ratios, np.flatnonzero(off >= SURE)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of every row with `score` (0 to 1); null texts score as empty ones."""
    fields = kept_fields(docs, keep)
    out = T.StructType(
        [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField("score", T.DoubleType())]
    )
    width = len(fields)
    source = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).alias("text"))

    def judge(batch):
        return [*batch.columns[:width], model.scores(utf8(batch.column(width)))]

    scored = arrow_map(source, judge, out)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")

"""Nearest chunks to questions, and the context text made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from planmatch.functions.predicates import named
from planmatch.functions.vectors import cosine
from planmatch.operators.joins import BROADCAST_ROWS
from planmatch.sources.storage import materialise

# Question vectors that travel with one pass over the base.
QUESTION_BYTES = 16_000_000
# Numbers (vector elements, or cosines) that a task works on at once.
TILE = 1 << 20
# Stands for a missing cosine, below all others.
MISSING = -2.0


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label; sums are combined per task before the exchange."""
    means = (
        vectors.select(named(label), F.posexplode(named(vector)).alias("pos", "x"))
        .groupBy(named(label), "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(named(label)).agg(F.transform(ordered, lambda s: s["x"]).alias(vector))


def _questions(
    questions: DataFrame, key: str, vector: str, question_bytes: int
) -> Iterator[tuple[list, np.ndarray]]:
    """Question keys in blocks of bounded bytes, each with its unit vectors, a row per
    question.

    A block holds vectors of one length. Questions without vector, or with a missing
    element, are left out.
    """
    asked = materialise(
        questions.select(named(key).alias("key"), named(vector).cast("array<double>").alias("vector")).where(
            F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
        ),
        "questions",
    )
    sizes = asked.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    for size, n in sorted(tuple(r) for r in sizes.collect()):  # a row per length
        blocks = -(-n * max(size, 1) * 8 // question_bytes)
        block = F.pmod(F.xxhash64("key", "vector"), F.lit(blocks))
        for i in range(blocks):
            rows = asked.where((F.size("vector") == size) & (block == i)).collect()
            if rows:
                with np.errstate(invalid="ignore"):
                    own = np.array([r[1] for r in rows], "float64").reshape(len(rows), size)
                    yield [r[0] for r in rows], own / np.linalg.norm(own, axis=1)[:, None]


def tiles(rows: int, width: int) -> Iterator[slice]:
    """`rows` in slices that make about TILE numbers with `width` to a row."""
    step = max(1, TILE // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(t.start, t.stop - t.start) for t in tiles(batch.num_rows, size))


def _units(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Vectors of a batch (key, vector) at length one. One of another length, with a missing
    element or of zeros only points nowhere and has missing elements."""
    column = batch.column(1)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = lengths == size
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    own = np.full((batch.num_rows, size), np.nan)
    own[fits] = flat[np.repeat(fits, lengths)].reshape(int(fits.sum()), size)
    length = np.linalg.norm(own, axis=1)
    length[length == 0] = np.nan
    with np.errstate(invalid="ignore"):
        return own / length[:, None]


class NearestRows:
    """The best `k` rows that a task has met for every question: by falling score (9
    decimals), ties by key, missing scores last. Cosines are made and dropped in tiles, so
    what is held is `k` rows per question and one tile."""

    def __init__(self, asked: np.ndarray, k: int, kind: pa.DataType):
        self.asked, self.k = asked, k
        self.order = np.full((len(asked), k), -np.inf)  # a free place
        self.score = np.full((len(asked), k), MISSING)
        self.row = np.full((len(asked), k), -1)
        self.keys = pa.array([], kind)  # of the rows that are held

    def meet(self, batch: pa.RecordBatch, groups: Callable = lambda batch: [(None, None)]) -> None:
        """`groups` gives places of rows with the numbers of the questions that they answer;
        None is all of them. It sees the batch in order of keys."""
        batch = batch.take(pc.array_sort_indices(batch.column(0), null_placement="at_start"))
        pool = pa.concat_arrays([self.keys, batch.column(0).cast(self.keys.type)])
        rank = np.empty(len(pool), np.int64)
        by_key = pc.array_sort_indices(pool, null_placement="at_start").to_numpy()
        rank[by_key] = np.arange(len(pool))
        own, held = _units(batch, self.asked.shape[1]), len(self.keys)
        for at, who in groups(batch):
            at = np.arange(len(own)) if at is None else at
            who = np.arange(len(self.asked)) if who is None else who
            mine = own[at].T
            for tile in tiles(len(who), len(at)):
                self._merge(who[tile], self.asked[who[tile]] @ mine, held + at, rank)
        used, row = np.unique(self.row, return_inverse=True)
        free = int(len(used) > 0 and used[0] < 0)
        self.row = row.reshape(self.row.shape) - free
        self.keys = pool.take(pa.array(used[free:]))

    def _merge(self, who: np.ndarray, scores: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> None:
        k = self.k
        scores[np.isnan(scores)] = MISSING
        # What may be among the best: no lower than the last that is held, but for rounding.
        may = scores >= (self.order[who, k - 1] - 1e-9)[:, None]
        many = np.flatnonzero(may.sum(axis=1) > k)
        if len(many):
            order = np.round(scores[many], 9)
            last = np.partition(order, order.shape[1] - k, axis=1)[:, -k, None]
            above, ties = order > last, order == last
            # Rows are in order of keys: of those that tie with the k-th the first stay.
            room = k - above.sum(axis=1, keepdims=True)
            may[many] = above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= room))
        q, at = np.nonzero(may)
        if not len(q):
            return
        some, q = np.unique(q, return_inverse=True)
        number, who = np.repeat(np.arange(len(some)), k), who[some]
        score = scores[some[q], at]
        question = np.concatenate([number, q])
        order = np.concatenate([self.order[who].ravel(), np.round(score, 9)])
        row = np.concatenate([self.row[who].ravel(), rows[at]])
        score = np.concatenate([self.score[who].ravel(), score])
        best = np.lexsort((rank[row], -order, question))
        # Every question has `k` places or more, one after another.
        first = np.searchsorted(question[best], np.arange(len(some)))
        best = best[first[:, None] + np.arange(k)]
        self.order[who], self.row[who], self.score[who] = order[best], row[best], score[best]

    def found(self, keys: list, arrow: pa.Schema) -> pa.RecordBatch:
        """(key, question key, score) of what is held."""
        q, place = np.nonzero(self.row >= 0)
        score = self.score[q, place]
        columns = [
            self.keys.take(pa.array(self.row[q, place])),
            pa.array(keys, arrow.types[1]).take(pa.array(q)),
            pa.array(score, mask=score == MISSING),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _each_block(parts: Iterator[DataFrame], empty: DataFrame) -> DataFrame:
    """The blocks' results together; more than one are written one after another, so that
    no task holds more than one block of questions and the driver two."""
    parts = iter(parts)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return empty if first is None else first
    return reduce(DataFrame.unionByName, [materialise(p, "scores") for p in chain([first, second], parts)])


def _score_schema(
    base: DataFrame, questions: DataFrame, base_key: str, question_key: str
) -> T.StructType:
    return T.StructType(
        [
            T.StructField(base_key, base.schema[base_key].dataType),
            T.StructField(question_key, questions.schema[question_key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _vectors(base: DataFrame, base_key: str, base_vector: str) -> DataFrame:
    return base.select(named(base_key), named(base_vector)).where(named(base_vector).isNotNull())


def score_all(
    base: DataFrame,
    questions: DataFrame,
    base_key: str,
    base_vector: str,
    question_key: str,
    question_vector: str,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """(base_key, question_key, score): cosine of every base vector with each question
    vector, in one narrow pass over the base per block of questions."""
    schema = _score_schema(base, questions, base_key, question_key)
    arrow = to_arrow_schema(schema)
    vectors = _vectors(base, base_key, base_vector)
    parts = (
        vectors.mapInArrow(_score_block(keys, asked, arrow), schema)
        for keys, asked in _questions(questions, question_key, question_vector, question_bytes)
    )
    return _each_block(parts, base.sparkSession.createDataFrame([], schema))


def _score_block(keys: list, asked: np.ndarray, arrow: pa.Schema) -> Callable:
    size = asked.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(keys, arrow.types[1])
        for batch in (cut for whole in batches for cut in _cut(whole, max(size, len(asked)))):
            units = _units(batch, size)
            rows = batch.num_rows
            for tile in tiles(len(asked), rows):
                scores = units @ asked[tile].T
                width = scores.shape[1]
                own = batch.column(0).take(pa.array(np.repeat(np.arange(rows), width)))
                whom = names.slice(tile.start, width).take(pa.array(np.tile(np.arange(width), rows)))
                score = pa.array(scores.ravel(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([own, whom, score], schema=arrow)

    return score


def best_per_question(scores: DataFrame, question_key: str, base_key: str, k: int) -> DataFrame:
    """`rank` 1..k by falling score (9 decimals, so that rounding noise makes no
    order), ties by key."""
    order = Window.partitionBy(named(question_key)).orderBy(
        F.round("score", 9).desc_nulls_last(), named(base_key)
    )
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_topk(
    base: DataFrame,
    questions: DataFrame,
    k: int,
    base_key: str,
    base_vector: str,
    question_key: str,
    question_vector: str,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Exact nearest vectors. Each task hands on its `k` best per question only, so
    the exchange carries tasks x questions x k rows however large the base is. Questions
    beyond `question_bytes` take further passes."""
    schema = _score_schema(base, questions, base_key, question_key)
    arrow = to_arrow_schema(schema)
    vectors = _vectors(base, base_key, base_vector)
    near = (
        vectors.mapInArrow(_nearest_block(keys, asked, arrow, k), schema)
        for keys, asked in _questions(questions, question_key, question_vector, question_bytes)
    )
    near = _each_block(near, base.sparkSession.createDataFrame([], schema))
    return best_per_question(near, question_key, base_key, k)


def _nearest_block(keys: list, asked: np.ndarray, arrow: pa.Schema, k: int) -> Callable:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = NearestRows(asked, k, arrow.types[0])
        for batch in batches:
            for cut in _cut(batch, asked.shape[1]):
                best.meet(cut)
        yield best.found(keys, arrow)

    return nearest


def ann_topk(
    base: DataFrame,
    questions: DataFrame,
    k: int,
    base_key: str,
    base_vector: str,
    question_key: str,
    question_vector: str,
    tables: int = 8,
    width: float = 0.5,
    seed: int = 7,
) -> DataFrame:
    """Approximate nearest vectors: only base vectors that share a random-projection
    bucket with a question are scored.

    The join is on (table, bucket). A pair met in several tables is scored in the
    first one only, so no distinct over pairs is needed. Questions that meet fewer than `k`
    vectors are answered by `cosine_topk`; column `exact` tells which.
    """
    asked = questions.select(
        named(question_key), named(question_vector).cast("array<double>").alias("_qv")
    )
    asked = materialise(asked.where(F.col("_qv").isNotNull()), "questions")
    own = _vectors(base, base_key, base_vector).select(
        named(base_key), named(base_vector).alias("_bv")
    )
    unit = Normalizer(inputCol="_vector", outputCol="_unit")
    hashed_questions = unit.transform(asked.withColumn("_vector", array_to_vector("_qv")))
    hashed_base = unit.transform(own.withColumn("_vector", array_to_vector("_bv")))
    model = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", bucketLength=width, numHashTables=tables, seed=seed
    ).fit(hashed_questions)
    b = _bucketed(model.transform(hashed_base), [base_key, "_bv"], "_bh")
    q = _bucketed(model.transform(hashed_questions), [question_key, "_qv"], "_qh")
    met = b.join(q, ["table", "bucket"])
    earlier = F.exists(
        F.arrays_zip(
            F.slice("_bh", F.lit(1), F.col("table")).alias("b"),
            F.slice("_qh", F.lit(1), F.col("table")).alias("q"),
        ),
        lambda p: p["b"] == p["q"],
    )
    scores = met.where(~earlier).select(
        named(base_key), named(question_key), cosine(F.col("_bv"), F.col("_qv")).alias("score")
    )
    near = materialise(best_per_question(scores, question_key, base_key, k), "near")
    full = near.groupBy(named(question_key)).count().where(F.col("count") >= k)
    lacking = materialise(asked.join(full, question_key, "left_anti"), "lacking")
    if lacking.isEmpty():
        return near.withColumn("exact", F.lit(False))
    rest = cosine_topk(base, lacking, k, base_key, base_vector, question_key, "_qv")
    return (
        near.join(full, question_key, "left_semi")
        .withColumn("exact", F.lit(False))
        .unionByName(rest.withColumn("exact", F.lit(True)))
    )


def _bucketed(hashed: DataFrame, keep: list[str], name: str) -> DataFrame:
    hashes = F.transform("_hashes", lambda h: F.get(vector_to_array(h), F.lit(0)))
    with_arrays = hashed.withColumn(name, hashes)
    return with_arrays.select(
        *[named(c) for c in keep], name, F.posexplode(name).alias("table", "bucket")
    )


def attach_texts(near: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Every row of `near` with the columns of its text; null where there is none. Texts
    stay where they are as long as the keys asked for are few, which is counted."""
    near = materialise(near, "near")
    keys = near.select(named(key)).distinct()
    few = near.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(keys) if few else keys, key, "left_semi")
    return near.join(found, key, "left")


def assemble_context(
    retrieved: DataFrame,
    questions: DataFrame,
    question_key: str,
    question_text: str,
    chunk_text: str,
    rank: str = "rank",
    template: str = "%s\n\nGiven the context:\n%s",
) -> DataFrame:
    """(question_key, prompt): the question with its chunks in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct(named(rank).alias("r"), F.coalesce(named(chunk_text), F.lit("")).alias("t"))))
    context = retrieved.groupBy(named(question_key)).agg(
        F.concat_ws("\n\n", F.transform(ordered, lambda c: c["t"])).alias("context")
    )
    return questions.join(context, question_key, "left").select(
        named(question_key),
        F.format_string(template, named(question_text), F.coalesce("context", F.lit(""))).alias("prompt"),
    )

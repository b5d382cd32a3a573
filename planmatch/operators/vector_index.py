"""An inverted file of vectors: every vector is written under its nearest centroid, and a
question reads the files of a few centroids only.

The centroids are fitted on a bounded sample (SAMPLE rows drawn by hash); every row is
indexed. How many cells a question visits is not guessed: for CALIBRATION vectors of the
base the exact neighbours are found, and so many cells are visited as hold `recall` of them.
The index is a folder of Parquet files partitioned by cell, written once and searched often.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from planmatch.functions.predicates import named
from planmatch.operators.retrieval import QUESTION_BYTES, NearestRows, best_per_question, cosine_topk, tiles
from planmatch.sources.storage import materialise, scratch_path

# Rows that the centroids are fitted on, and vectors whose neighbours are found exactly.
SAMPLE = 20_000
CALIBRATION = 64
# Largest number of cells; their centroids travel with the tasks.
MOST_CELLS = 4096
# Cell of the vectors that have no cosine: of another length, with a missing or not finite
# element, or of zeros only.
NOWHERE = -1


@dataclass
class VectorIndex:
    """`path` holds (key, vector) by `cell`; `centroids` are unit vectors, a row per cell
    that holds `held` rows; a question visits `visits` cells."""

    path: str
    key: str
    schema: T.StructType
    centroids: np.ndarray
    held: np.ndarray
    visits: int
    _rows: DataFrame | None = None

    def rows(self, spark: SparkSession) -> DataFrame:
        """(key, vector, cell); the folders of the cells are listed once."""
        if self._rows is None:
            self._rows = spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return self._rows

    def save(self, spark: SparkSession) -> None:
        note = {
            "key": self.key,
            "schema": self.schema.json(),
            "visits": self.visits,
            "size": self.centroids.shape[1],
            "held": self.held.tolist(),
            "cells": self.centroids.tolist(),
        }
        spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.text(f"{self.path}/note")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    centroids = np.array(note["cells"], "float64").reshape(-1, note["size"])
    schema = T.StructType.fromJson(json.loads(note["schema"]))
    held = np.array(note["held"], "int64")
    return VectorIndex(path, note["key"], schema, centroids, held, note["visits"])


def _usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def build_index(
    base: DataFrame,
    key: str,
    vector: str,
    *,
    k: int = 10,
    recall: float = 0.95,
    path: str | None = None,
    cells: int | None = None,
    sample: int = SAMPLE,
    calibration: int = CALIBRATION,
    seed: int = 7,
) -> VectorIndex:
    """Index of every row whose vector is not null; `cells` defaults to the root of the
    number of rows. Vectors without a cosine stand in a cell of their own that no question
    visits. `visits` is set so that `recall` of the `k` nearest of `calibration` vectors lie
    in the cells they visit. An empty base has no cells."""
    spark = base.sparkSession
    path = path or scratch_path(spark, "vectors")
    own = base.select(named(key).alias("key"), named(vector).cast("array<double>").alias("vector"))
    own = own.where(F.col("vector").isNotNull())
    # As many rows as there are lengths; the usual one is indexed.
    sizes = own.groupBy(F.size("vector").alias("size")).count().collect()
    rows = max((r["count"] for r in sizes), default=0)
    size = max((r["size"] for r in sizes if r["count"] == rows), default=0)
    usable = own.where(_usable(F.col("vector"), size))
    place = F.xxhash64("key", "vector", F.lit(seed))
    share = F.lit(min(1.0, sample / max(rows, 1)))
    drawn = usable.where(F.pmod(place, F.lit(1 << 30)) <= share * (1 << 30))
    drawn = materialise(drawn.select("key", "vector"), "drawn")
    have = drawn.count()
    cells = max(1, min(cells or round(rows**0.5), MOST_CELLS, have))
    if cells == 1 and have:
        # One cell holds everything, wherever its middle is.
        centroids = np.array([drawn.select("vector").first()[0]], "float64")
        centroids /= np.linalg.norm(centroids)
    elif have:
        fitted = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(
            drawn.select(array_to_vector("vector").alias("features"))
        )
        centroids = np.array(fitted.clusterCenters(), "float64")
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1), 1e-300)[:, None]
    else:
        centroids = np.zeros((0, size))
    _write(own, size, centroids, f"{path}/rows")
    held = np.zeros(len(centroids), "int64")
    written = spark.read.schema("cell int").parquet(f"{path}/rows").where(F.col("cell") != NOWHERE)
    for r in written.groupBy("cell").count().collect():  # a row per cell
        held[r["cell"]] = r["count"]
    schema = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())])
    index = VectorIndex(path, key, schema, centroids, held, len(centroids))
    if have:
        index.visits = _visits(index, drawn, k, recall, calibration)
    index.save(spark)
    return index


def _write(own: DataFrame, size: int, centroids: np.ndarray, path: str) -> None:
    """Rows in ranges of (cell, hash of the key), so that a hot cell takes many tasks and a
    task writes few files."""
    placed = own.withColumn("usable", _usable(F.col("vector"), size))
    schema = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cell = np.full(batch.num_rows, NOWHERE, "int32")
            if fits.any():
                have = batch.column(1).filter(pa.array(fits))
                have = have.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                near = [np.argmax(have[t] @ centroids.T, axis=1) for t in tiles(len(have), len(centroids))]
                cell[fits] = np.concatenate(near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], schema=arrow)

    found = placed.mapInArrow(place, schema)
    dealt = found.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell")
    dealt.write.partitionBy("cell").parquet(path)


def _visits(index: VectorIndex, drawn: DataFrame, k: int, recall: float, calibration: int) -> int:
    """So many of its nearest cells hold `recall` of a vector's `k` neighbours."""
    spark = drawn.sparkSession
    asked = drawn.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(calibration).select("vector").collect()
    vectors = np.array([r[0] for r in asked], "float64")
    questions = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "question int, asked array<double>"
    )
    rows = index.rows(spark).where(F.col("cell") != NOWHERE)
    # A row is known to the search by its cell and its key.
    rows = rows.select(F.concat_ws("|", "cell", F.col("key").cast("string")).alias("key"), "vector")
    near = cosine_topk(rows, questions, k, "key", "vector", "question", "asked")
    order = np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    cell = F.split("key", "[|]")[0].cast("int")
    needed = sorted(int(place[r[0], r[1]]) for r in near.select("question", cell).collect())
    return 1 + needed[max(0, int(np.ceil(recall * len(needed))) - 1)]


def search_index(
    index: VectorIndex,
    questions: DataFrame,
    k: int,
    question_key: str,
    question_vector: str,
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """(key, question_key, score, rank, exact): the nearest `k` rows in the cells that a
    question visits. A block of questions of bounded bytes reads the files of its cells
    only. A question that finds fewer than `k` rows there, as one of another length does, is
    answered by all rows (`exact`). Questions without vector, or with a missing element, are
    left out; a question of zeros has no cosine with any row."""
    spark = questions.sparkSession
    size = index.centroids.shape[1]
    asked = questions.select(
        named(question_key).alias("q"), named(question_vector).cast("array<double>").alias("asked")
    )
    asked = asked.where(F.col("asked").isNotNull() & ~F.exists("asked", lambda x: x.isNull()))
    # The other questions are answered by all rows; of them only the key is needed here.
    short = asked.select("q", F.when(_usable(F.col("asked"), size), F.col("asked")).alias("asked"))
    # A question travels with its vector and a bit per cell.
    most = max(1, question_bytes // (8 * max(size, 1) + len(index.centroids) // 8 + 1))
    first = short.limit(most + 1).collect()
    if len(first) <= most:
        return _search_block(index, asked, first, k, question_key, questions, question_bytes)
    asked, short = materialise(asked, "questions"), materialise(short, "questions")
    blocks = -(-short.count() // most)
    parts = []
    for block in range(blocks):
        mine = short.where(F.pmod(F.xxhash64("q", "asked"), F.lit(blocks)) == block).collect()
        found = _search_block(index, asked, mine, k, question_key, questions, question_bytes)
        # Written, so that no task holds more than one block.
        parts.append(materialise(found, "near"))
    return reduce(DataFrame.unionByName, parts)


def _search_block(
    index: VectorIndex,
    asked: DataFrame,
    mine: list,
    k: int,
    question_key: str,
    questions: DataFrame,
    question_bytes: int,
) -> DataFrame:
    spark, rows = asked.sparkSession, index.rows(asked.sparkSession)
    kind = questions.schema[question_key].dataType
    schema = T.StructType(
        [
            T.StructField(index.key, rows.schema["key"].dataType),
            T.StructField(question_key, kind),
            T.StructField("score", T.DoubleType()),
        ]
    )
    near, lacking = spark.createDataFrame([], schema), [r[0] for r in mine if r[1] is None]
    fit = [r for r in mine if r[1] is not None]
    if fit:
        vectors = np.array([r[1] for r in fit], "float64")
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        # The rows of a cell are known, so it is known who will find too few.
        visits, met = _visited(index, vectors)
        enough = met >= k
        lacking += [r[0] for r, e in zip(fit, enough) if not e]
        fit, vectors, visits = [r for r, e in zip(fit, enough) if e], vectors[enough], visits[enough]
    if fit:
        cells = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(visits, axis=0))).tolist()
        visited = rows.where(F.col("cell").isin(cells)).select("key", "vector", "cell")
        near = visited.mapInArrow(
            _nearest_in_cells([r[0] for r in fit], vectors, visits, schema, k), schema
        )
    near = best_per_question(near, question_key, index.key, k).withColumn("exact", F.lit(False))
    if not lacking:
        return near
    keys = spark.createDataFrame([(q,) for q in lacking], T.StructType([T.StructField("l", kind)]))
    rest = asked.join(F.broadcast(keys), asked["q"].eqNullSafe(keys["l"]), "left_semi")
    every = rows.select(F.col("key").alias(index.key), "vector")
    rest = rest.withColumnRenamed("q", question_key)
    rest = cosine_topk(every, rest, k, index.key, "vector", question_key, "asked", question_bytes)
    return near.unionByName(rest.withColumn("exact", F.lit(True)))


def _visited(index: VectorIndex, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every question a bit per cell, set for the `visits` nearest (of equally near ones
    the first), and the number of rows that they hold."""
    cells, most = len(index.centroids), min(index.visits, len(index.centroids))
    bits, met = [], []
    for t in tiles(len(vectors), cells):
        near = vectors[t] @ index.centroids.T
        last = np.partition(near, cells - most, axis=1)[:, cells - most, None]
        above, ties = near > last, near == last
        room = most - above.sum(axis=1, keepdims=True)
        visited = above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= room))
        bits.append(np.packbits(visited, axis=1))
        met.append(visited @ index.held)
    return np.concatenate(bits), np.concatenate(met)


def _nearest_in_cells(
    keys: list, asked: np.ndarray, visits: np.ndarray, schema: T.StructType, k: int
) -> Callable:
    """Best `k` rows of a task for every question, out of the cells whose bits it has set."""
    arrow = to_arrow_schema(schema)

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = batch.column(2).to_numpy(zero_copy_only=False)
        for c in np.unique(cell):
            who = np.flatnonzero(visits[:, c >> 3] & (128 >> (c & 7)))
            at = np.flatnonzero(cell == c)
            yield from ((at[t], who) for t in tiles(len(at), 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = NearestRows(asked, k, arrow.types[0])
        for batch in batches:
            for t in tiles(batch.num_rows, asked.shape[1]):
                best.meet(batch.slice(t.start, t.stop - t.start), groups)
        yield best.found(keys, arrow)

    return nearest

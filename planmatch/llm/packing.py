"""Packing token sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows; what is left of each is
packed into the open sequence with the tightest room. Pieces of one length are
interchangeable, so the plan needs only how many there are of each length: it is made from
that histogram (at most `size` rows whatever the corpus), for runs of equal sequences at
once, with a segment tree over the remaining room that finds the tightest one. Pieces then
look up their place by (length, rank within the length). Texts stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, utf8
from planmatch.llm.tokens import PieceEncoder
from planmatch.sources.storage import materialise

SEQUENCE = 4096
END_OF_TEXT = 2


class RoomTree:
    """Which amounts of room occur among open sequences; a segment tree of counts."""

    def __init__(self, most: int):
        self.width = 1
        while self.width <= most:
            self.width *= 2
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int:
        """Smallest room of at least `need` that occurs, or -1."""
        at = need + self.width
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at *= 2
                    if not self.count[at]:
                        at += 1
                return at - self.width
            at //= 2
        return -1


@dataclass(frozen=True)
class Plan:
    """Rows sorted by (length, rank): pieces of `length` from `rank` on go `per` to a
    sequence, from sequence `first` and place `offset` on."""

    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and rank within the length."""
        key = length.astype(np.int64) << 48 | rank
        row = np.searchsorted(self.length.astype(np.int64) << 48 | self.rank, key, "right") - 1
        i = rank - self.rank[row]
        return self.first[row] + i // self.per[row], self.offset[row] + i % self.per[row] * length


def best_fit_plan(counts: dict[int, int], size: int, first: int = 0) -> Plan:
    """Best-fit decreasing over a histogram of lengths (1 to `size`).

    Equal open sequences are kept as runs. A piece goes where the room is tightest, and so
    do the next ones of its length while they still fit there: a run of `m` equal sequences
    takes m * (room // length) pieces at a stroke. The steps depend on `size` alone.
    """
    tree = RoomTree(size)
    runs: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    made = first

    def open_run(room: int, begin: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((begin, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                per = size // length
                n = -(-left // per)
                begin, room = made, size
                made += n
            else:
                begin, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                tree.add(room, -n)
            per = room // length
            used = min(left, n * per)
            rows.append((length, rank, per, begin, size - room))
            full, rest = divmod(used, per)
            open_run(room - per * length, begin, full)
            if rest:
                open_run(room - rest * length, begin + full, 1)
            open_run(room, begin + full + bool(rest), n - full - bool(rest))
            rank += used
            left -= used
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*table, sequences=made)


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END_OF_TEXT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, rank): full windows and the rest
    of every document. `rank` numbers the pieces of a length within their task."""
    kind = docs.schema[doc_id].dataType.simpleString()
    struct = T.StructType.fromDDL(
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, rank bigint"
    )

    def cut(batches):
        encoder = PieceEncoder.of(tokenizer)
        task = TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for batch in batches:
            owner, rows = [], []
            for row, raw in enumerate(utf8(batch.column(1))):
                ids = np.append(np.frombuffer(encoder.encode(raw), "<u2"), end).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rank = met.get(len(piece), 0)
                    met[len(piece)] = rank + 1
                    owner.append(row)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, rank))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=struct.names,
            )

    return docs.select(named(doc_id), named(text)).mapInArrow(cut, struct)


def pack(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END_OF_TEXT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Each document is its ids and `end`; null texts are empty and come to `end` alone.
    Sequence numbers run from 0 without gaps. Repeated rows are packed each for itself;
    an empty table gives no rows.
    """
    # Written once: ranks given by a task stay what they are if it is run again.
    pieces = materialise(token_pieces(docs, tokenizer, size, end, doc_id, text), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    below = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as tasks x lengths; texts of one length cannot gather beyond their task.
    starts = per_task.select("length", "task", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(histogram, size)

    ranked = pieces.join(starts, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("below")).alias("rank")
    )
    kind = docs.schema[doc_id].dataType.simpleString()

    def place(batch):
        sequence, offset = plan.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
        return [*batch.columns[:5], sequence, offset]

    return arrow_map(
        ranked, place,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )

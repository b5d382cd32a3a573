"""Benchmark decontamination: which words of a document lie inside a benchmark passage.

A prefix-filtered set join. The words of a window are ordered by rarity (documents of the
corpus that hold them, counted over all documents). Containment is asked in full, so the
necessary prefix of a window is its rarest word alone: a document without that word cannot
hold the window. Where the word is met, the window's place is known; it has to lie inside
the document (positional and length bounds), and then its words are compared one by one.

The benchmark is the stated query set. It travels with the tasks in blocks whose bytes are
measured first; each block is one narrow pass over the documents, with no shuffle of text.
A benchmark beyond one block only means further passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, kept_fields, utf8
from planmatch.sources.storage import materialise

WINDOW = 10
# Benchmark text that travels with one pass over the documents.
BLOCK_BYTES = 2_000_000

# Fixed value: word characters are 0-9, a-z (A-Z folded) and everything beyond ASCII.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

Index = dict[bytes, list[tuple[int, int, dict[tuple[bytes, ...], list[int]]]]]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows_of(words: Sequence[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Windows of consecutive words; a shorter, non-empty item is one window."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def build_index(items: Sequence[Sequence[bytes]], rarity: dict[bytes, int], window: int) -> Index:
    """Windows under their rarest word, by (length, place of that word)."""
    index: Index = {}
    for number, words in enumerate(items):
        for win in windows_of(words, window):
            place = min(range(len(win)), key=lambda j: (rarity.get(win[j], 0), win[j], j))
            shapes = index.setdefault(win[place], [])
            for length, offset, known in shapes:
                if length == len(win) and offset == place:
                    break
            else:
                known = {}
                shapes.append((len(win), place, known))
            owners = known.setdefault(win, [])
            if not owners or owners[-1] != number:
                owners.append(number)
    return index


def find_windows(words: Sequence[bytes], index: Index) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges covered by windows of the index (merged, ascending) and their items."""
    met: list[tuple[int, int]] = []
    owners: set[int] = set()
    size = len(words)
    for i, word in enumerate(words):
        if word not in index:
            continue
        for length, offset, known in index[word]:
            start = i - offset
            if start < 0 or start + length > size:
                continue
            items = known.get(tuple(words[start : start + length]))
            if items is not None:
                met.append((start, start + length))
                owners.update(items)
    return merge_ranges(met), owners


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> DataFrame:
    """(item, text, block): distinct items, dealt into blocks that are weighed; the
    number of blocks doubles until the heaviest is light enough or holds one item."""
    items = materialise(
        benchmark.where(named(item_id).isNotNull() & named(text).isNotNull())
        .select(named(item_id).cast("string").alias("item"), named(text).alias("text"))
        .distinct(),
        "benchmark",
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))
        if blocks == 1:
            return dealt
        weights = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
        if weights.where((F.col("b") > block_bytes) & (F.col("n") > 1)).isEmpty():
            return dealt
        blocks *= 2


def document_frequency(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of a bounded vocabulary, counted over all documents;
    tasks hand on one row per word."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in utf8(batch.column(0)):
                seen.update(vocabulary.intersection(words_of(raw)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    counted = docs.select(named(text)).mapInArrow(count, "word binary, n bigint")
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}


def benchmark_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The kept columns of every row of `docs`, with n_words, `spans` (word ranges inside
    occurrences, ascending, disjoint) and `items` (ids as strings, sorted, distinct).

    Null or empty texts have no words; repeated rows are judged each for itself; items
    without id or words match nothing; an item id that comes with several texts is one
    item. Columns other than `keep` and `text` are never read.
    """
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    fields = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept_fields(docs, keep))]
    state = T.StructType(
        [
            *fields,
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType.fromDDL("start int, end int"))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    width = len(fields)
    found = docs.select(
        *[named(c).alias(f"k{i}") for i, c in enumerate(keep)], named(text).alias("text")
    )
    for block in range(n_blocks):
        rows = blocks.where(F.col("block") == block).collect()  # at most block_bytes of text
        names = [r["item"] for r in rows]
        items = [words_of(r["text"].encode()) for r in rows]
        rarity = document_frequency(docs, text, {w for words in items for w in words})
        index = build_index(items, rarity, window)
        first, last = block == 0, block == n_blocks - 1

        def judge(batch, index=index, names=names, first=first, last=last):
            counts, spans, owners = [], [], []
            before_spans = None if first else batch.column(width + 2).to_pylist()
            before_items = None if first else batch.column(width + 3).to_pylist()
            for row, raw in enumerate(utf8(batch.column(width))):
                words = words_of(raw)
                met, mine = find_windows(words, index)
                named_items = {names[i] for i in mine}
                if not first:
                    met = merge_ranges(met + [(s["start"], s["end"]) for s in before_spans[row]])
                    named_items.update(before_items[row])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in met])
                owners.append(sorted(named_items))
            texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(width)
            return [*batch.columns[:width], texts, counts, spans, owners]

        found = arrow_map(found, judge, state)
        if not last:
            found = materialise(found, "passages")
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of `docs` that hold no benchmark passage."""
    return benchmark_passages(docs, benchmark, keep=columns).where(F.size("spans") == 0).select(*columns)

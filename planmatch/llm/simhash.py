"""Near copies by SimHash: deletion-variant signatures.

A fingerprint has 64 bits; two link when at most three differ. Cut into two halves, one of
them differs in at most one bit. So every half is indexed under its 32 variants with one
bit taken out, and two fingerprints with a common variant are met by an equality join and
verified. Distinct fingerprints only: copies of a text meet once, however many they are.

A variant that very many fingerprints share (a large group of near copies) is split further
by the same rule: within it the other half differs by at most three bits, so one of that
half's two quarters differs by at most one, and the variants of the quarters join the key.
Nothing is capped; both sides of a pair see the same keys.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from planmatch.functions.predicates import named
from planmatch.llm.batches import LOWER, arrow_map, utf8
from planmatch.operators.joins import join_back
from planmatch.sources.storage import materialise

SHINGLE = 3
SEED = 42
BITS = 3  # fixed by the cut into two halves
# Fingerprints under one half from which its variants are split further.
CROWDED = 1024
# Kept rows are broadcast as digest and id up to this many.
KEEPERS = 300_000


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included: its words as a whole where
    they are fewer than `width`, nothing without words."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    begins = [0, *ends]
    shingles = [joined[a : b - 1] for a, b in zip(begins, ends[width - 1 :])]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(raw: bytes) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words."""
    hashes = shingle_hashes(raw, SHINGLE)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batch):
        values = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
        return [batch.column(0), values.view(np.int64)]

    return arrow_map(docs.select(named(doc_id), named(text)), judge, f"doc_id {kind}, fp bigint")


def _half(fp: Column, which: int) -> Column:
    """Bits of a half as a long: 0 is the upper one."""
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _first_shared(a: Column, b: Column, bit: Column) -> Column:
    """Of the variants that two values share, the pair is reported under one only: where
    they differ, or bit 0 when they are equal."""
    return (a != b) | (bit == 0)


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b, once: the distinct fingerprints `fp` of `nodes` that differ in at
    most three bits. Equal fingerprints are one node."""
    halves = nodes.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("h"), _half(F.col("fp"), 0).alias("v")),
                                F.struct(F.lit(1).alias("h"), _half(F.col("fp"), 1).alias("v")))).alias("x")
    ).select("fp", "x.h", "x.v")

    def variants(of: DataFrame) -> DataFrame:
        return of.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn(
            "key",
            F.call_function("shiftleft", (F.col("h") * 32 + F.col("bit")).cast("long"), F.lit(32))
            .bitwiseOR(_without(F.col("v"), F.col("bit"))),
        )

    # A variant is crowded only if one of its two halves is half as crowded.
    full = (
        halves.groupBy("h", "v").agg(F.count("*").alias("n")).where(F.col("n") > crowded // 2).drop("n")
    )
    full = materialise(full, "crowded")
    index = variants(halves).select("fp", "h", "v", "bit", "key")
    if full.isEmpty():
        plain, split = index, None
    else:
        hot = variants(full).select("key").distinct().withColumn("hot", F.lit(True))
        marked = index.join(hot.hint("merge"), "key", "left")
        plain = marked.where(F.col("hot").isNull()).drop("hot")
        split = marked.where(F.col("hot")).drop("hot")

    def pairs(left: DataFrame, on: list[str], extra) -> DataFrame:
        a, b = left.alias("a"), left.alias("b")
        same = F.lit(True)
        for c in on:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= BITS)
        # Found under the upper half already: not again under the lower one.
        once = (F.col("a.h") == 0) | (F.bit_count(F.shiftrightunsigned(differ, 32)) > 1)
        # Sizes are guessed from the unexploded table: without the hint it would be broadcast.
        met = a.join(b.hint("merge"), same & near & once & _first_shared(F.col("a.v"), F.col("b.v"), F.col("a.bit")) & extra)
        return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    found = pairs(plain, ["key"], F.lit(True))
    if split is None:
        return found
    other = F.when(F.col("h") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    quarters = (
        split.withColumn("o", other)
        .withColumn("q", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("w", F.when(F.col("q") == 0, F.shiftright("o", 16)).otherwise(F.col("o").bitwiseAND(F.lit(0xFFFF))))
        .withColumn("wbit", F.explode(F.sequence(F.lit(0), F.lit(15))))
        .withColumn("key2", ((F.col("q") * 16 + F.col("wbit")) * 65536 + _without(F.col("w"), F.col("wbit"))))
        .select("fp", "h", "v", "bit", "key", "o", "q", "w", "wbit", "key2")
    )
    upper = F.shiftright(F.col("a.o").bitwiseXOR(F.col("b.o")), 16)
    extra = _first_shared(F.col("a.w"), F.col("b.w"), F.col("a.wbit")) & (
        (F.col("a.q") == 0) | (F.bit_count(upper) > 1)
    )
    return found.unionByName(pairs(quarters, ["key", "key2"], extra))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Alternating star contraction: each round hangs the larger neighbours of a node, then
    the smaller ones, under the smallest. Every step is one aggregate and one join, written
    to the shared folder; a node with very many edges is one row of the aggregate, and its
    edges may be spread over several tasks in the join.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def hang(near: DataFrame) -> DataFrame:
        """near(u, v): every v goes under the smallest of u and its neighbours. Written, the
        minima are broadcast where they are small and otherwise leave Spark free to split
        the edges of a hub."""
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return near.join(materialise(least, "least"), "u").select("v", "u", "m")

    # (u, v): v is the smaller end.
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both).where(F.col("v") > F.col("u"))
        # Repeats stay for half a round: no more rows than there were edges.
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        met = hang(large)
        small = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(met.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "small")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _rooted(rows: DataFrame, crowded: int) -> DataFrame:
    """(fp, n, root, component_id) for the fingerprints of rows(doc_id, fp)."""
    nodes = materialise(
        rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes"
    )
    roots = materialise(
        components(links(nodes.select("fp"), crowded)).select(F.col("node").alias("fp"), "root"), "roots"
    )
    # Both ends of a link: the root itself has no row of its own.
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "n", "root", "component_id")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED
) -> DataFrame:
    """(doc_id, fp, component_id) for every row, repeats included.

    component_id is the smallest doc_id of all rows whose fingerprints can be reached over
    links. Null and empty texts have fingerprint 0 and link like any other. A row without
    id takes part; where no row of a component has an id, component_id is null.
    """
    rows = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    return join_back(rows, _rooted(rows, crowded).drop("root"), ["fp"], ["doc_id"])


def one_of_each(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`columns` of one row per component: the row with the smallest id, rows without id
    last; of rows that repeat that id those of the smallest fingerprint, of these the
    smallest row. Components are told apart by their fingerprints, so unlike texts under
    one id are not taken for one. Null and empty texts are one component. An empty table
    gives no rows; columns of `docs` beside those asked for may have any name.

    Texts stay where they are unless more than KEEPERS rows are kept.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    node = F.unhex(F.md5(F.coalesce(named(text), F.lit(""))))

    def judge(batch):
        values = np.array([fingerprint(t) for t in utf8(batch.column(2))], np.uint64)
        return [batch.column(0), batch.column(1), values.view(np.int64)]

    used = docs.select(named(doc_id).alias("doc_id"), node.alias("node"), named(text).alias("text"))
    marked = materialise(arrow_map(used, judge, f"doc_id {kind}, node binary, fp bigint"), "fingerprints")
    rooted = _rooted(marked.select("doc_id", "fp"), CROWDED).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "node", "n")
    ids = marked.groupBy("fp", "doc_id").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    firsts = ids.groupBy("fp").agg(F.min(order).alias("first"))
    keepers = firsts.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keepers = materialise(
        keepers.select("root", F.col("first.fp").alias("fp_"), F.col("first.node").alias("node_"), F.col("first.doc_id").alias("id_"), "first.n"),
        "keepers",
    )
    row = docs.select(node.alias("node"), named(doc_id).alias("id"), F.struct(*[named(c) for c in columns]).alias("row"))

    def rows_of(kept: DataFrame, how: str) -> DataFrame:
        kept = F.broadcast(kept) if kept.count() <= KEEPERS else kept
        return row.join(kept, (F.col("node") == F.col("node_")) & F.col("id").eqNullSafe(F.col("id_")), how)

    found = rows_of(keepers.where("n = 1").select("node_", "id_"), "left_semi").select("row")
    again = keepers.where("n > 1").drop("node_")
    if not again.isEmpty():
        # Several rows of that id in the fingerprint: of one text or of several.
        own = (F.col("fp") == F.col("fp_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
        nodes = marked.distinct().join(again, own).select(F.col("node").alias("node_"), "id_", "root")
        nodes = materialise(nodes, "nodes")
        found = found.unionByName(rows_of(nodes, "inner").groupBy("root").agg(F.min("row").alias("row")).select("row"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in columns])

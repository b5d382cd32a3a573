"""Near copies by b-bit MinHash: texts whose sets of word shingles have a Jaccard similarity
of at least SHARE.

A text's signature has BANDS x ROWS minima of its hashed shingles. Each band of ROWS minima
is a key; texts that share one are candidates (at 0.8 all but 6 in 100,000 pairs do). Of every
minimum BITS low bits are kept and packed. Two minima that differ agree in these by chance
in one of 2^BITS cases, so a similarity s shows as s + (1 - s) / 2^BITS agreeing lanes, which
are counted by XOR and bit counts. Candidates that stay SIGMAS standard deviations below
what SHARE would show are dropped; the others are compared on their whole sets.

Copies of a text are one node. Pairs never grow with the square of a group of similar
texts: under each key all members are compared with one of them, the one that most others
meet over all keys (the text that the copies were made from, where there is one). Texts that
are connected then need no further comparison. Under keys that hold texts of several
components those meet, under the first key that they share, with a wider signature of
WIDE lanes in the join itself, so that what leaves the join is almost only links.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map, utf8
from planmatch.llm.simhash import components, shingle_hashes
from planmatch.operators.joins import join_back
from planmatch.sources.storage import materialise

SHINGLE = 4
BANDS = 32
ROWS = 6
BITS = 2  # fixed by the way that lanes are compared
LANES = BANDS * ROWS
WIDE = 2048
# Similar: the share of common shingles is at least SHARE[0] / SHARE[1].
SHARE = (4, 5)
SIGMAS = 4
# Wanted nodes are broadcast up to this many.
NODES = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EVEN_BITS = 0x5555555555555555


def _multipliers(lanes: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 64, lanes, np.uint64) | np.uint64(1)


def shingle_set(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; none without words."""
    return np.unique(shingle_hashes(raw, width))


def minima(members: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One minimum per lane; a lane orders the hashes by their product with its multiplier."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(multipliers))
    for at in range(0, len(members), step):
        np.minimum(least, (members[at : at + step] * multipliers[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of ROWS minima each; the number of the band is part of the key."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least[:LANES].reshape(BANDS, ROWS).T:
        keys = ((keys ^ (keys >> np.uint64(29))) * _MIX) ^ row
    return keys


def packed(least: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, 32 lanes to a long. Low bits of a product are low bits of
    its factors alone, so they are taken after mixing."""
    mixed = (least ^ (least >> np.uint64(32))) * _MIX >> np.uint64(62)
    lanes = mixed.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(lanes, axis=1)


def least_agreeing(lanes: int, share: tuple[int, int] = SHARE, sigmas: float = SIGMAS) -> int:
    """Agreeing lanes below which a pair is taken to be less similar than `share`."""
    s = share[0] / share[1]
    p = s + (1 - s) / (1 << BITS)
    return math.floor(lanes * p - sigmas * math.sqrt(lanes * p * (1 - p)))


def similarity(agreeing: int, lanes: int) -> float:
    """Estimated Jaccard similarity: agreeing lanes, less those that agree by chance."""
    chance = 1 / (1 << BITS)
    return max(0.0, (agreeing / lanes - chance) / (1 - chance))


def agreeing_lanes(a: Column, b: Column, lanes: int) -> Column:
    """Lanes that agree in both bits, of two packed signatures."""
    differ = F.lit(0)
    for i in range(lanes // 32):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN_BITS)))
    return F.lit(lanes) - differ


def _sized(a: str, b: str, share: tuple[int, int]) -> Column:
    """Sets of such sizes can be similar."""
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def node_of(text: str) -> Column:
    """Texts with the same digest are one node; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(named(text), F.lit(""))))


def signatures(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, node, size, keys, bits) per row; no keys and bits for an empty set."""
    kind = docs.schema[doc_id].dataType.simpleString()
    multipliers = _multipliers(LANES)

    def sign(batch):
        sizes, keys, bits = [], [], []
        for raw in utf8(batch.column(2)):
            members = shingle_set(raw, width)
            sizes.append(len(members))
            least = minima(members, multipliers) if len(members) else None
            keys.append(None if least is None else band_keys(least).view(np.int64))
            bits.append(None if least is None else packed(least).view(np.int64))
        return [batch.column(0), batch.column(1), sizes, keys, bits]

    used = docs.select(named(doc_id).alias("doc_id"), node_of(text).alias("node"), named(text).alias("text"))
    return arrow_map(used, sign, f"doc_id {kind}, node binary, size bigint, keys array<bigint>, bits array<bigint>")


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(node, text), once for every wanted node; `wanted` is a written table of nodes."""
    texts = docs.select(node_of(text).alias("node"), named(text).alias("text"))
    few = wanted.count() <= NODES  # 16 bytes each
    met = texts.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    return met.groupBy("node").agg(F.first("text").alias("text"))


def similar(docs: DataFrame, pairs: DataFrame, text: str, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets are similar. A set travels once
    for a pair and once for each task of a hub's pairs."""
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(wanted, "wanted")

    def judge(batch):
        return [batch.column(0), [shingle_set(t, width).view(np.int64) for t in utf8(batch.column(1))]]

    sets = materialise(arrow_map(_texts(docs, wanted, text), judge, "node binary, members array<bigint>"), "sets")
    # Both sides of both joins are exchanges of written tables or joins, which Spark splits
    # where a hub is hot; the hub comes last, so the sets that move are its partners'.
    met = pairs
    for end in ("b", "a"):
        met = met.join(sets.select(F.col("node").alias(end), F.col("members").alias(f"of_{end}")), end)
    both = F.size(F.array_intersect("of_a", "of_b"))
    total = F.size("of_a") + F.size("of_b") - both
    return materialise(met.where(both * share[1] >= total * share[0]).select("a", "b"), "similar")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, band, node, size, bits, met) of the keys that several nodes share; met counts
    the meetings of the node over all its keys."""
    keys = nodes.select(F.posexplode("keys").alias("band", "key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("others", F.col("n") - 1)
    members = join_back(keys, shared, ["key"], ["node"]).where(F.col("others").isNotNull())
    members = materialise(members, "members")
    met = members.groupBy("node").agg(F.sum("others").alias("met"))
    known = met.join(nodes.select("node", "size", "bits"), "node")
    return materialise(members.drop("others").join(known, "node"), "known")


def _with_hub(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): every member b of a key with the member a that most others meet, where sizes
    and signatures allow."""
    best = F.max(F.struct("met", "size", "node", "bits")).alias("hub")
    hubs = members.groupBy("key").agg(best).select(
        "key", F.col("hub.node").alias("a"), F.col("hub.size").alias("hub_size"), F.col("hub.bits").alias("hub_bits")
    )
    met = members.join(materialise(hubs, "hubs"), "key").where(F.col("a") != F.col("node"))
    near = agreeing_lanes(F.col("bits"), F.col("hub_bits"), LANES) >= least_agreeing(LANES, share)
    return met.where(_sized("size", "hub_size", share) & near).select("a", F.col("node").alias("b"))


def _across(docs: DataFrame, members: DataFrame, nodes: DataFrame, roots: DataFrame, text: str, width: int,
            share: tuple[int, int]) -> DataFrame:
    """(a, b): members of a key that are in different components, where sizes and wide
    signatures allow; each pair under the first key that it shares."""
    rooted = members.select("key", "band", "node").join(roots, "node", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = materialise(mixed.where("low != high").select("key"), "mixed")
    left = materialise(rooted.join(mixed, "key"), "open")
    multipliers = _multipliers(LANES + WIDE)[LANES:]

    def widen(batch):
        least = [minima(shingle_set(t, width), multipliers) for t in utf8(batch.column(1))]
        return [batch.column(0), [packed(m).view(np.int64) for m in least]]

    wanted = materialise(left.select("node").distinct(), "wanted")
    wide = arrow_map(_texts(docs, wanted, text), widen, "node binary, wide array<bigint>")
    marks = F.transform("keys", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("marks")
    wide = materialise(wide.join(nodes.select("node", "size", marks), "node"), "wide")
    # Both sides read the same columns, so that they share one exchange.
    left = left.join(wide, "node")
    a, b = left.alias("a"), left.alias("b")
    earlier = F.exists(
        F.arrays_zip(F.slice("a.marks", F.lit(1), F.col("a.band")).alias("x"), F.slice("b.marks", F.lit(1), F.col("a.band")).alias("y")),
        lambda m: m["x"] == m["y"],
    )
    rule = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.root") < F.col("b.root"))
        & _sized("a.size", "b.size", share)
        & (agreeing_lanes(F.col("a.wide"), F.col("b.wide"), WIDE) >= least_agreeing(WIDE, share))
        & ~earlier
    )
    # Sizes are guessed too small for a table of arrays: without the hint it may be broadcast.
    return a.join(b.hint("merge"), rule).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def linked(docs: DataFrame, nodes: DataFrame, text: str, width: int, share: tuple[int, int]) -> DataFrame:
    """(node, root) of every node that is linked to another: the smallest node that can be
    reached."""
    members = _members(nodes)
    found = similar(docs, _with_hub(members, share), text, width, share)
    roots = materialise(components(found), "roots")
    more = similar(docs, _across(docs, members, nodes, roots, text, width, share), text, width, share)
    if more.isEmpty():
        return roots
    return materialise(components(found.unionByName(more)), "roots")


def near_sets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, share: tuple[int, int] = SHARE
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row, repeats included.

    Texts are linked when the share of common shingles (`width` words; of fewer words the
    whole sequence) is at least share[0] / share[1]; component_id is the smallest doc_id
    that can be reached over links, the row's own included, null where no row of the
    component has an id. `kept`: the row has that id or neither has one, so rows that repeat
    an id are kept together. Null texts and texts without words have an empty set, are
    linked with nothing and keep their own id. An empty table gives no rows. Columns other
    than `doc_id` and `text` are not read.

    Signatures are probable: a pair at 0.8 is missed about 6 times in 100,000, more similar
    ones less often. What is linked was compared on whole sets.
    """
    rows = materialise(signatures(docs, doc_id, text, width), "signatures")
    nodes = rows.where("size > 0").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("size", "keys", "bits")], F.min("doc_id").alias("first"), F.count("*").alias("n")
    )
    nodes = materialise(nodes, "nodes")
    roots = linked(docs, nodes, text, width, share)
    rooted = nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named_nodes = rooted.join(least, "root").select("node", "component_id", "n")
    out = join_back(rows.select("doc_id", "node", F.col("size").alias("n_shingles")), named_nodes, ["node"], ["doc_id"])
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

"""Contiguous shards of about equal bytes.

Rows are ranged by id; every range partition adds up its bytes, the totals of the
partitions below give each its start, and a running sum inside the partition places every
row in the whole corpus. Shards are cut at equal byte targets. No text is moved: only id,
size and checksum are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.sources.storage import materialise


def byte_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, position, shard, slot) for every row, repeats included.

    size: UTF-8 bytes plus 1, null text counts as empty. Order: doc_id (nulls first), then
    size and checksum; rows equal in all of these go by their place in the scan. A row
    belongs to the shard whose byte range holds its middle, so a shard misses its target
    by at most one row at each end. An empty table gives no rows.
    """
    content = F.coalesce(named(text), F.lit(""))
    # A written table: the scan's row numbers stay what they are when a task is run again.
    rows = materialise(
        docs.select(
            named(doc_id).alias("doc_id"),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.monotonically_increasing_id().alias("scan"),
        ),
        "sizes",
    )
    order = ["doc_id", "size", "text_crc32", "scan"]
    ranged = materialise(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged"
    )
    # One row per partition.
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("b").over(below), F.lit(0)).alias("bytes_below"),
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("rows_below"),
    )
    total = totals.agg(F.sum("b")).first()[0] or 1
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(starts), "part").select(  # as many rows as partitions
        "doc_id",
        "size",
        "text_crc32",
        (F.row_number().over(inside) - 1 + F.col("rows_below")).alias("position"),
        (F.sum("size").over(inside) - F.col("size") + F.col("bytes_below")).alias("before"),
    )
    # The row's middle, doubled, in whole numbers.
    shard = F.expr(f"int((2 * before + size) * {shards} div {2 * total})")
    cut = materialise(placed.withColumn("shard", F.least(shard, F.lit(shards - 1))), "cut")
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "position",
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
    )

"""Joining a per-key result back to the many rows it was derived from.

The large side may hold a third of its rows under one key. The small side has
one row per key and knows, in column `n`, how many large-side rows the key has,
so hot keys are known before the join and only they are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.sources.storage import materialise

# A keyed result is broadcast up to this many rows and characters of JSON.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64_000_000


def join_back(
    big: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    n: str = "n",
    broadcast_rows: int = BROADCAST_ROWS,
    slices: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Left join of `big` with `keyed` (unique, non-null `on`; frequency column `n`).

    * `keyed` small (counted and weighed, not guessed): broadcast, `big` stays put.
    * otherwise a shuffle join in which a key with more than its fair share of
      rows is spread over several tasks by a hash of the `spread` columns. At
      most `slices` keys can exceed 1/slices of all rows, so the list of hot
      keys is bounded whatever the data.

    The column `n` is used up. `keyed` is written first, unless it is a `written` table.
    """
    if not written:
        keyed = materialise(keyed, "keyed")
    width = F.length(F.to_json(F.struct("*")))
    rows, total, size = keyed.agg(F.count(F.lit(1)), F.sum(n), F.sum(width)).first()
    if rows <= broadcast_rows and (size or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(keyed.drop(n)), list(on), "left")

    spark = big.sparkSession
    if slices is None:
        slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(1, (total or 0) // slices)
    parts = F.ceil(F.col(n) / fair).cast("int")
    hot = keyed.where(F.col(n) > fair).select(*[named(c) for c in on], parts.alias("_parts"))
    salted_big = big.join(F.broadcast(hot), list(on), "left").withColumn(
        "_salt",
        F.coalesce(
            F.pmod(F.xxhash64(*[named(c) for c in spread]), F.col("_parts")).cast("int"),
            F.lit(0),
        ),
    )
    salted_keyed = keyed.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    ).drop(n)
    return salted_big.join(salted_keyed, [*on, "_salt"], "left").drop("_salt", "_parts")

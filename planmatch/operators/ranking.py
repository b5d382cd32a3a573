"""Global positions, ranks and exact quantiles without a single-task sort.

Rows are first counted per distinct value (map-side combine removes any skew),
distinct values are split into ranges of about equal size, positions are counted
inside each range and shifted by the totals of the ranges below. Groups are dealt by
hash; only those with more values than a range holds are split into ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.operators.joins import join_back
from planmatch.sources.storage import materialise

# Distinct values handled by one task.
VALUES_PER_RANGE = 200_000


def value_positions(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: Column | None = None,
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """One row per distinct (by, value): `n` its rows, `before` the rows with a
    smaller value in the group, `distinct_before` the smaller distinct values.

    With `weight`, `n` and `before` add that integer column instead of counting.
    """
    groups = [named(c) for c in by]
    counted = materialise(
        df.where(named(value).isNotNull())
        .groupBy(*groups, named(value))
        .agg(F.sum(F.lit(1) if weight is None else weight).alias("n")),
        "counts",
    )
    if by:
        sizes = counted.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
        # At most as many groups as there are full ranges.
        large = materialise(sizes.where(F.col("_size") > values_per_range).drop("_size"), "large")
        if large.isEmpty():
            return _placed(counted.withColumn("_range", F.lit(0)), value, by)
        large = F.broadcast(large.select(*[g.alias(f"_g{i}") for i, g in enumerate(groups)]))
        same = reduce(lambda x, y: x & y, [g.eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
        small = counted.join(large, same, "left_anti").withColumn("_range", F.lit(0))
        rest = materialise(counted.join(large, same, "left_semi"), "rest")
        return _placed(small, value, by).unionByName(_ranged(rest, value, by, values_per_range))
    if counted.count() <= values_per_range:
        return _placed(counted.withColumn("_range", F.lit(0)), value, by)
    return _ranged(counted, value, by, values_per_range)


def _placed(counted: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Positions inside each (by, _range)."""
    groups = [named(c) for c in by]
    inside = Window.partitionBy(*groups, "_range").orderBy(named(value))
    return counted.withColumn("before", F.sum("n").over(inside) - F.col("n")).withColumn(
        "distinct_before", F.row_number().over(inside) - 1
    ).drop("_range")


def _ranged(counted: DataFrame, value: str, by: Sequence[str], values_per_range: int) -> DataFrame:
    """Positions over ranges of (by, value); `counted` is a written table of more rows than
    a range has."""
    groups = [named(c) for c in by]
    ranges = counted.count() // values_per_range + 1
    # Any type that sorts; equal values share a range, NaN is the largest number.
    ranged = counted.repartitionByRange(ranges, *groups, named(value))
    counted = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*groups, "_range").orderBy(named(value))
    placed = counted.withColumn(
        "_before", F.sum("n").over(inside) - F.col("n")
    ).withColumn("_distinct", F.row_number().over(inside) - 1)

    below = Window.partitionBy(*[f"_g{i}" for i in range(len(by))]).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        counted.groupBy(*[g.alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range"))
        .agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"))
        .withColumn("_n_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .withColumn("_d_below", F.coalesce(F.sum("_d").over(below), F.lit(0)))
        .drop("_n", "_d")
        .withColumnRenamed("_range", "_of")
    )
    same = F.col("_range") == F.col("_of")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"_g{i}"))
    return placed.join(totals, same).select(
        *groups,
        named(value),
        "n",
        (F.col("_before") + F.col("_n_below")).alias("before"),
        (F.col("_distinct") + F.col("_d_below")).alias("distinct_before"),
    )


def rank_all(df: DataFrame, value: str, spread: Sequence[str]) -> DataFrame:
    """Every row with its global `rank` and `dense_rank`, ascending; null values unranked."""
    places = value_positions(df, value).select(
        named(value),
        "n",
        (F.col("before") + 1).alias("rank"),
        (F.col("distinct_before") + 1).alias("dense_rank"),
    )
    return join_back(df, places, [value], spread)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of `probabilities`."""
    groups = [named(c) for c in by]
    places = materialise(value_positions(df, value, by), "places")
    totals = places.groupBy(*groups).agg(F.sum("n").alias("_total"))
    if by:
        own = totals.select(*[g.alias(f"_g{i}") for i, g in enumerate(groups)], "_total")
        same = F.lit(True)
        for i, g in enumerate(groups):
            same = same & g.eqNullSafe(F.col(f"_g{i}"))
        sized = places.join(own, same).drop(*[f"_g{i}" for i in range(len(groups))])
    else:
        total = totals.first()["_total"]
        sized = places.withColumn("_total", F.lit(total))

    def at(position: Column) -> Column:
        inside = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(inside, named(value)))

    picks = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            at(F.floor(place)).alias(f"_{name}_low"),
            at(F.ceil(place)).alias(f"_{name}_high"),
        ]
    picked = sized.groupBy(*groups).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*groups, *out)

"""Question shapes a catalog must answer: matches, counts, averages, rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import UNLIMITED, Condition, conjunction, named
from planmatch.operators.ranking import exact_quantiles, rank_all
from planmatch.operators.relax import relax_single
from planmatch.operators.shaping import project_requested
from planmatch.sources.storage import materialise


def match(df: DataFrame, conds: Sequence[Condition], labels: Sequence[str]) -> DataFrame:
    """Several attributes at once; gives way as far as needed."""
    return relax_single(df, conds, labels).rows


def largest_group(df: DataFrame, by: str) -> DataFrame:
    """The group with most rows, ties by name."""
    counts = df.groupBy(named(by)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), named(by)).limit(1)


def count_where(df: DataFrame, conds: Sequence[Condition]) -> DataFrame:
    return df.where(conjunction(conds)).agg(F.count(F.lit(1)).alias("n"))


def area_of_cheapest(
    df: DataFrame, conds: Sequence[Condition], area: str, price: str, key: str
) -> DataFrame:
    chosen = df.where(conjunction(conds) & named(price).isNotNull())
    order = F.struct(named(price), named(key))
    return chosen.agg(
        F.min_by(named(area), order).alias(area), F.min(named(price)).alias(price)
    )


def average_where(df: DataFrame, conds: Sequence[Condition], by: str, value: str) -> DataFrame:
    return df.where(conjunction(conds)).groupBy(named(by)).agg(
        F.round(F.avg(named(value)), 6).alias("average"), F.count(F.lit(1)).alias("n")
    )


def budget_near(
    people: DataFrame, places: DataFrame, place: str, value: str, place_key: str, people_key: str,
    place_name: str, neighbourhood: str,
) -> DataFrame:
    """Spread of a value over everyone in the neighbourhood of a place."""
    around = places.where(named(place_name) == place).select(named(neighbourhood))
    near = places.join(around, neighbourhood, "left_semi").select(named(place_key))
    chosen = people.join(near, named(people_key) == named(place_key), "left_semi").select(named(value))
    quartiles = exact_quantiles(chosen, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    ends = chosen.agg(F.min(named(value)).alias("low"), F.max(named(value)).alias("high"))
    ends = ends.withColumn("_one", F.lit(1))
    return quartiles.withColumn("_one", F.lit(1)).join(ends, "_one").drop("_one")


def rank_by_price(df: DataFrame, price: str, key: str) -> DataFrame:
    return rank_all(df.select(named(key), named(price)), price, [key])


def bounded_with_all(df: DataFrame, bound: Condition, have: Column, wanted: Sequence[str]) -> DataFrame:
    """Within a bound and holding every wanted item."""
    holds = [F.array_contains(have, w) for w in wanted]
    return df.where(reduce(lambda a, b: a & b, holds, conjunction([bound])))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.round(F.corr(named(x), named(y)), 6).alias("correlation"))


def largest_modest_group(
    df: DataFrame, by: str, price: str, conds: Sequence[Condition]
) -> DataFrame:
    """The group with most qualifying rows among those not above the median of the
    group means."""
    stats = materialise(
        df.groupBy(named(by)).agg(
            F.round(F.avg(named(price)), 9).alias("mean"),
            F.count_if(conjunction(conds)).alias("n"),
        ),
        "groups",
    )
    median = exact_quantiles(stats, "mean", {"median": 0.5}).select("median").scalar()
    modest = stats.where((F.col("mean") <= median) & (F.col("n") > 0))
    return modest.select(named(by), "n").orderBy(F.desc("n"), named(by)).limit(1)


def within_budget_unlimited(
    df: DataFrame, price: str, budget: float, unlimited: str, amount: str, at_least: float
) -> DataFrame:
    return df.where(
        (named(price) <= budget)
        & named(unlimited).isin(list(UNLIMITED))
        & (named(amount) >= at_least)
    )


def at_least(
    df: DataFrame, column: str, least: float, compulsory: Sequence[str]
) -> DataFrame:
    return project_requested(df.where(named(column) >= least), [column], compulsory)

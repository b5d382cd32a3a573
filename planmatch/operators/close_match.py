"""Approximate categories for request tables: which catalog values are close to which
wanted texts, found by equi-joins on pieces of text instead of comparing all pairs.

* containment: a value holds a wanted text when one of its substrings of that length
  equals it;
* few edits: cut the wanted text into one piece more than the allowed edits; one
  piece must survive unchanged, at most that many places away. Pairs sharing such a
  piece are then measured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.operators.joins import join_back


def _pieces(text: Column, size: Column, sizes: list[int]) -> Column:
    """Every substring with one of the given lengths, with its place from 0."""
    per_length = [
        F.when(
            size >= n,
            F.transform(
                F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))),
                lambda p: F.struct(F.substring(text, p + 1, F.lit(n)).alias("piece"), p.alias("place")),
            ),
        )
        for n in sizes
    ]
    return F.flatten(F.filter(F.array(*per_length), lambda a: a.isNotNull()))


def close_values(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, value) for every wanted text and catalog value that are close, by the
    same rule as `predicates.close_to`. values(value) and wanted(text) are distinct."""
    have = values.where(F.col("value").isNotNull()).select(
        "value", F.lower(F.trim("value")).alias("have")
    )
    have = have.withColumn("size", F.length("have"))
    want = wanted.where(F.col("text").isNotNull()).select(
        "text", F.lower(F.trim("text")).alias("want")
    )
    want = want.withColumn("length", F.length("want")).withColumn(
        "edits", F.greatest(F.lit(1), F.floor(F.col("length") / 4).cast("int"))
    )
    # As many rows as there are different text lengths.
    lengths = sorted(r[0] for r in want.select("length").distinct().collect())

    parts = have.select("value", F.explode(_pieces(F.col("have"), F.col("size"), lengths)).alias("p"))
    parts = parts.select("value", F.col("p.piece").alias("want")).distinct()
    holding = parts.join(want.select("text", "want"), "want").select("text", "value")

    def edge(i: Column) -> Column:
        return F.floor(i * F.col("length") / (F.col("edits") + 1)).cast("int")

    cuts = F.transform(
        F.sequence(F.lit(0), F.col("edits")),
        lambda i: F.struct(
            F.substring("want", edge(i) + 1, edge(i + 1) - edge(i)).alias("piece"),
            edge(i).alias("start"),
        ),
    )
    asked = want.select("text", "want", "length", "edits", F.explode(cuts).alias("c")).select(
        "text",
        "want",
        "length",
        "edits",
        F.col("c.piece").alias("piece"),
        F.explode(
            F.sequence(
                F.greatest(F.col("c.start") - F.col("edits"), F.lit(0)),
                F.col("c.start") + F.col("edits"),
            )
        ).alias("place"),
    )
    piece_sizes = sorted(
        {n // (max(1, n // 4) + 1) + up for n in lengths for up in (0, 1)}
    )
    offered = have.select(
        "value", "have", "size", F.explode(_pieces(F.col("have"), F.col("size"), piece_sizes)).alias("p")
    ).select("value", "have", "size", "p.piece", "p.place")
    met = offered.join(asked, ["piece", "place"]).where(
        F.abs(F.col("size") - F.col("length")) <= F.col("edits")
    )
    edited = met.where(F.levenshtein("have", "want") <= F.col("edits")).select("text", "value")
    return holding.unionByName(edited).distinct()


def expand_close(
    catalog: DataFrame, constraints: DataFrame, columns: list[str], joins: dict
) -> DataFrame:
    """Replace `~` conditions on the given columns by `in` lists of the close values."""
    mine = (F.col("op") == "~") & F.col("col").isin(columns)
    fuzzy = constraints.where(mine).withColumn("text", F.get("values", F.lit(0)))
    dictionaries = []
    for column in columns:
        asked = fuzzy.where((F.col("col") == column) & F.col("text").isNotNull())
        wanted = asked.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        values = catalog.select(named(column).alias("value")).distinct()
        close = close_values(values, wanted.select("text")).groupBy("text")
        found = wanted.join(close.agg(F.collect_set("value").alias("close")), "text")
        dictionaries.append(found.withColumn("col", F.lit(column)))
    dictionary = reduce(DataFrame.unionByName, dictionaries)
    expanded = join_back(fuzzy, dictionary, ["col", "text"], ["request_id"], **joins).select(
        "request_id",
        "ord",
        "col",
        F.lit("in").alias("op"),
        F.coalesce("close", F.array().cast("array<string>")).alias("values"),
    )
    kept = constraints.where(~mine).select("request_id", "ord", "col", "op", "values")
    return kept.unionByName(expanded)

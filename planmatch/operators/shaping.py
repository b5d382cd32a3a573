"""From qualifying rows to the answer: projection, order, top rows, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planmatch.functions.predicates import named

# Fixed value: the text that stands for a missing reply.
NOTHING_FOUND = "Nothing found"


def project_requested(
    df: DataFrame, relevant: Sequence[str], compulsory: Sequence[str] = ()
) -> DataFrame:
    """Relevant and compulsory columns, in that order; all columns if any is missing."""
    wanted = list(dict.fromkeys([*relevant, *compulsory]))
    if not set(wanted) <= set(df.columns):
        return df
    return df.select(*[named(c) for c in wanted])


def price_order(df: DataFrame, price: str, key: str | None) -> list[Column]:
    """Ascending price, nulls last, ties by key; nothing when price was projected away."""
    if price not in df.columns:
        return []
    order = [named(price).asc_nulls_last()]
    if key and key in df.columns:
        order.append(named(key).asc())
    return order


def sort_by_price(df: DataFrame, price: str = "price", key: str | None = None) -> DataFrame:
    order = price_order(df, price, key)
    return df.orderBy(*order) if order else df


def top_rows(
    df: DataFrame, n: int = 3, price: str = "price", key: str | None = None
) -> DataFrame:
    """First `n` rows by price; sort and limit meet in one top-k operator."""
    return sort_by_price(df, price, key).limit(n)


def top_rows_by(
    df: DataFrame, by: Sequence[str], n: int, price: str, key: str
) -> DataFrame:
    """First `n` rows per group, numbered in `pos`; trimmed before the shuffle."""
    window = Window.partitionBy(*[named(c) for c in by]).orderBy(
        named(price).asc_nulls_last(), named(key)
    )
    return df.withColumn("pos", F.row_number().over(window)).where(F.col("pos") <= n)


def rows_to_column_map(
    df: DataFrame, by: Sequence[str], key: str, columns: Sequence[str], pos: str = "pos"
) -> DataFrame:
    """Per group one map {row key: value} for every column, entries in `pos` order.

    Meant for answers already cut to a few rows per group.
    """
    rows = F.array_sort(
        F.collect_list(
            F.struct(
                named(pos).alias("pos"),
                named(key).alias("key"),
                *[named(c).alias(f"v{i}") for i, c in enumerate(columns)],
            )
        )
    )
    grouped = df.groupBy(*[named(c) for c in by]).agg(rows.alias("_rows"))
    maps = [
        F.map_from_entries(
            F.transform("_rows", lambda r: F.struct(r["key"], r[f"v{i}"]))
        ).alias(c)
        for i, c in enumerate(columns)
    ]
    return grouped.select(*[named(c) for c in by], *maps)


def or_nothing_found(reply: Column) -> Column:
    return F.coalesce(reply, F.lit(NOTHING_FOUND))


def result_envelope(answers: DataFrame) -> DataFrame:
    """One JSON body per request, or an error row where `error` is set.

    Expects request_id, query, sql, labels, stored_weights, final_query, plans
    (a struct of column maps, or null when nothing qualified) and error.
    """
    # The keys of an answer, in its order.
    body = F.to_json(
        F.struct(
            F.col("query").alias("User query"),
            F.col("sql").alias("SQL queries"),
            F.col("labels"),
            F.col("stored_weights"),
            F.array("final_query").alias("Final Queries"),
            F.array("plans").alias("plans"),
            F.lit(None).cast(T.StringType()).alias("benefits"),
        ),
        {"ignoreNullFields": "false"},
    )
    failed = F.to_json(F.struct(F.col("error")))
    ok = F.col("error").isNull()
    return answers.select(
        "request_id",
        F.when(ok, 200).otherwise(500).alias("status"),
        F.when(ok, body).otherwise(failed).alias("body"),
    )


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelopes.write.json(path)

"""Stand-in inputs derived from the given tables.

No table holds requests, conditions or relevance, so every customer becomes one
request whose wishes follow from the customer's own attributes. All arithmetic is
exact in any SQL engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each market segment asks for; TINY is in no catalog row and
# FURNITURE customers have no wish.
SEGMENT_TYPES = {
    "AUTOMOBILE": "PROMO",
    "BUILDING": "ECONOMY",
    "HOUSEHOLD": "SMALL",
    "MACHINERY": "TINY",
}
# The same wishes as people misspell them.
MISSPELT_TYPES = {
    "AUTOMOBILE": "PROMOS",
    "BUILDING": " Econimy",
    "HOUSEHOLD": "mall",
    "MACHINERY": "tinny",
}
# Labels in the order used by the score arithmetic.
LABELS = ("p_brand", "p_size", "p_retailprice", "p_type", "delivery")


CATALOG_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` with some types and sizes missing."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.withColumns(
        {
            "p_type": F.when(key % 7 != 0, F.col("p_type")),
            "p_size": F.when(key % 5 != 0, F.col("p_size")),
        }
    )


def requests(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("Something for "), "c_name").alias("query"),
    )


def constraints(customer: DataFrame, close: bool = False) -> DataFrame:
    """Brand by nation (an absent one when in debt), size and price by balance, type
    by segment; with `close`, the type is misspelt and need only be close."""
    balance = F.col("c_acctbal")
    brand = F.when(balance < 0, F.lit("Brand#99")).otherwise(
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    )
    wanted_type = F.lit(None).cast("string")
    for segment, name in (MISSPELT_TYPES if close else SEGMENT_TYPES).items():
        wanted_type = F.when(F.col("c_mktsegment") == segment, name).otherwise(wanted_type)
    conditions = F.array(
        _condition(1, "p_brand", "=", brand),
        _condition(2, "p_size", "<=", F.floor(balance / 200).cast("string")),
        _condition(3, "p_retailprice", "<=", (F.floor(balance / 100) + 900).cast("string")),
        _condition(4, "p_type", "~" if close else "=", wanted_type),
    )
    return (
        customer.select(F.col("c_custkey").alias("request_id"), F.inline(conditions))
        .where(F.get("values", F.lit(0)).isNotNull())
    )


def _condition(ord_: int, col: str, op: str, *values: Column) -> Column:
    return F.struct(
        F.lit(ord_).alias("ord"),
        F.lit(col).alias("col"),
        F.lit(op).alias("op"),
        F.array(*values).alias("values"),
    )


def relevance(customer: DataFrame) -> DataFrame:
    """Scores per label; households give none for size, only region 0 asks for delivery."""
    key = F.col("c_custkey")
    scored = [
        F.struct(
            F.lit(label).alias("col"),
            (((key * 31 + i * 17) % 100) / F.lit(100.0)).alias("score"),
        )
        for i, label in enumerate(LABELS)
    ]
    return customer.select(
        key.alias("request_id"), "c_mktsegment", "c_nationkey", F.inline(F.array(*scored))
    ).where(
        ~((F.col("col") == "p_size") & (F.col("c_mktsegment") == "HOUSEHOLD"))
        & ~((F.col("col") == "delivery") & (F.col("c_nationkey") >= 5))
    ).select("request_id", "col", "score")


# Columns that the wide requests constrain, in the order of the score arithmetic.
WIDE_LABELS = (
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_linenumber",
    "l_returnflag",
    "l_linestatus",
)


def line_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `lineitem`, with one key column."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").withColumn("l_key", F.concat_ws("|", *parts))


def wide_constraints(supplier: DataFrame) -> DataFrame:
    """One request per supplier with wishes on five numeric columns and two flags; no line
    has the status X."""
    key = F.col("s_suppkey")

    def pick(values: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))

    conditions = F.array(
        _condition(1, "l_quantity", ">=", (key % 5 * 10).cast("string")),
        _condition(2, "l_extendedprice", "<=", ((key % 7 + 1) * 10000).cast("string")),
        _condition(3, "l_discount", "between", pick(("0.0", "0.02", "0.04")), pick(("0.05", "0.07", "0.1"))),
        _condition(4, "l_tax", "<=", pick(("0.02", "0.05"))),
        _condition(5, "l_linenumber", ">", (key % 4).cast("string")),
        _condition(6, "l_returnflag", "in", pick(("A", "N")), pick(("R", "N"))),
        _condition(7, "l_linestatus", "=", pick(("X", "O", "F"))),
    )
    return supplier.select(key.alias("request_id"), F.inline(conditions))


def wide_relevance(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    scored = [
        F.struct(F.lit(c).alias("col"), (((key * 31 + i * 17) % 100) / F.lit(100.0)).alias("score"))
        for i, c in enumerate(WIDE_LABELS)
    ]
    return supplier.select(key.alias("request_id"), F.inline(F.array(*scored)))


# Columns that requests for orders constrain.
ORDER_LABELS = ("o_orderdate", "o_orderpriority", "o_totalprice")


def order_constraints(supplier: DataFrame) -> DataFrame:
    """One request per supplier: a span of dates, one in five of them after the last order,
    priorities from a letter on and a limit to the price."""
    key = F.col("s_suppkey")
    since = F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 2900).cast("int"))
    until = F.date_add(since, (key % 60).cast("int"))
    conditions = F.array(
        _condition(1, "o_orderdate", "between", since.cast("string"), until.cast("string")),
        _condition(2, "o_orderpriority", ">=", (key % 6 + 1).cast("string")),
        _condition(3, "o_totalprice", "<=", ((key % 9 + 1) * 20000).cast("string")),
    )
    return supplier.select(key.alias("request_id"), F.inline(conditions))


def order_relevance(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    scored = [
        F.struct(F.lit(c).alias("col"), (((key * 31 + i * 17) % 100) / F.lit(100.0)).alias("score"))
        for i, c in enumerate(ORDER_LABELS)
    ]
    return supplier.select(key.alias("request_id"), F.inline(F.array(*scored)))


def untidy_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` whose types are written in mixed case and with stray blanks."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.col("p_type")
    untidy = (
        F.when(key % 3 == 0, F.lower(kind))
        .when(key % 3 == 1, F.concat(F.lit(" "), kind, F.lit("  ")))
        .otherwise(kind)
    )
    return part.withColumn("p_type", F.when(key % 7 != 0, untidy))


# ---------------------------------------------------------------- sessions

# Label of each letter whose share in a turn is its weight.
LETTER_LABELS = {"e": "brand", "i": "delivery", "n": "price", "t": "size", "r": "type"}


def turn_weights(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, label, weight): share of a letter in the whole text of a turn."""
    text = F.lower("text")

    def share(letter: str) -> Column:
        count = F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
        return F.round(count / F.length(text), 6)

    scored = F.array(
        *[
            F.struct(F.lit(label).alias("label"), share(letter).alias("weight"))
            for letter, label in LETTER_LABELS.items()
        ]
    )
    return (
        turns.where(F.length("text") > 0)
        .select("conv_id", "turn", F.inline(scored))
        .where(F.col("weight") > 0)
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

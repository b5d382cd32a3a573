"""Recorded replies of the classifier and of the column chooser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.functions.text import last_bracket_slice, parse_name_list

CLASSIFIER_SCHEMA = "array<struct<labels:array<string>,scores:array<double>>>"


def classifier_relevance(replies: DataFrame, reply: str, request: str = "request_id") -> DataFrame:
    """(request_id, col, score) from JSON replies; the first element of each counts."""
    first = F.get(F.from_json(named(reply), CLASSIFIER_SCHEMA), F.lit(0))
    pairs = F.arrays_zip(first["labels"].alias("col"), first["scores"].alias("score"))
    return replies.select(named(request).alias("request_id"), F.inline(pairs))


def column_lists(replies: DataFrame, reply: str, request: str = "request_id") -> DataFrame:
    """(request_id, slice, names, bad): the list in each reply; `bad` marks replies to
    set aside."""
    sliced = replies.select(
        named(request).alias("request_id"), last_bracket_slice(named(reply)).alias("slice")
    )
    parsed = sliced.withColumn("names", parse_name_list(F.col("slice")))
    return parsed.withColumn("bad", F.col("names").isNull())

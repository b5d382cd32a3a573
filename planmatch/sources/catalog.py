"""Catalog files: CSV with a header and a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Quotes inside quoted fields are doubled; blanks belong to the values.
OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_catalog(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = False,
    bad: str | None = None,
) -> DataFrame:
    """Any path Spark can read. Without a schema the types are inferred, which costs
    an extra pass over the file.

    `multi_line` allows line breaks inside quotes; such a file is read by one task, so it
    is off unless asked for. With `bad` (and a schema) a column of that name holds the raw
    line of rows that do not fit the schema, and is null for all others.
    """
    reader = spark.read.options(**OPTIONS, multiLine=multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if bad is not None:
        schema = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    return reader.schema(schema).csv(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.options(**OPTIONS).csv(path)

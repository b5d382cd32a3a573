"""Texts under a directory, read recursively."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, text), one row per file; or, with `separator`, one row per separated
    text, which keeps the number of files small and large files splittable.

    A path that is no directory gives one row with a message in `error`.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        if separator is None:
            texts = reader.text(path, wholetext=True)
        else:
            texts = reader.option("lineSep", separator).text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        # Fixed value: the text of this failure.
        message = f"Not a valid directory: {path}"
        return spark.range(1).select(
            F.lit(path).alias("path"),
            F.lit(None).cast("string").alias("text"),
            F.lit(message).alias("error"),
        )
    return texts.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def write_documents(df: DataFrame, text: str, folders: list[str], path: str, separator: str) -> None:
    """Texts into one directory level per column of `folders`."""
    df.select(*folders, text).write.partitionBy(*folders).option("lineSep", separator).text(path)

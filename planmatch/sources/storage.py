"""Intermediate tables in the shared folder the cluster names.

Written tables cut lineage and survive lost executors. They also come back with
a true file size, so Catalyst broadcasts them only when they really are small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of a query when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where none is set, a temporary folder, but only in one JVM:
    executors elsewhere would each write to a disk of their own."""
    context = spark.sparkContext
    setting = "spark.checkpoint.dir"
    root = (
        spark.conf.get(setting, None)
        or context.getConf().get(setting)
        or context.getCheckpointDir()
    )
    if root:
        return root.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="planmatch-")
    return _OWN_ROOT[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/planmatch-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator that go when nothing reads them any more, and the shuffle
    files behind them as soon as they are written."""

    def __init__(self):
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """`materialise`; without the setting, shuffle files stay until the driver happens to
        collect its garbage, which may be after all other tables are written."""
        spark = df.sparkSession
        self._paths[name] = path = scratch_path(spark, name)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path)

    def remove(self, spark: SparkSession, *names: str) -> None:
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan in at least as many tasks as there are cores, for row-local work that
    costs more than moving the row. Large inputs are split finely already and stay
    where they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def explosion_tasks(df: DataFrame) -> int:
    """Tasks for a stage whose rows multiply after the exchange, where coalescing by
    input size would leave one task with everything."""
    spark = df.sparkSession
    cores = 2 * spark.sparkContext.defaultParallelism
    return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))

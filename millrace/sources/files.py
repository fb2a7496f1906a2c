"""Reading and writing tables as files through Spark's own readers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path that the driver and all executors reach: below spark.checkpoint.dir, in local runs the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.millrace"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def register(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> None:
    """Temporary views of a folder's tables, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows, as VALUES has them."""
    return spark.createDataFrame(rows, schema)


def write(df: DataFrame, path: str, cluster_by: str | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet, sorted by a column inside each file so that readers can skip row groups."""
    (df.sortWithinPartitions(cluster_by) if cluster_by else df).write.mode(mode).parquet(path)

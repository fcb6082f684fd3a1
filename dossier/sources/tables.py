"""Table scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossier.session import PART_BYTES, size_parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
SMALL_BYTES = 256 * 1024 * 1024


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A scan whose rows reach every core.

    A table of a few row groups would keep one task busy with all that follows,
    so small ones are dealt out; larger tables split by themselves and are not moved.
    """
    df = read(spark, folder, name)
    size = _size(spark, folder, name)
    if size < SMALL_BYTES:
        return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))
    return df


def parts_of(spark: SparkSession, folder: str, name: str) -> int:
    """The number of parts to deal a table out to: one for each ``PART_BYTES``, and at least one for each core.

    With fewer parts than a shuffle has Spark would deal the rows again for a join.
    """
    size = _size(spark, folder, name)
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    usual = int(first or spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, usual, -(-size // PART_BYTES))


def _size(spark: SparkSession, folder: str, name: str) -> int:
    sizes = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}.parquet").select(F.sum("length"))
    size = sizes.first()[0] or 0
    size_parts(spark, size)
    return size


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder; nothing is read before a query asks for it."""
    return {name: read(spark, folder, name) for name in TABLES}

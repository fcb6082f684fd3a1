"""Session settings and the two helpers that need to know where the job runs."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("dossier")
    settings = {
        **CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SMALL_PARTS = {"spark.sql.files.maxPartitionBytes": "8MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}
SHORT_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}  # the JVM compiles no longer ones; Spark then makes several
PART_BYTES = 4 * 1024 * 1024


def size_parts(spark: SparkSession, input_bytes: int) -> None:
    """Keep the share of a task small where rows multiply after the scan, so that its sorts stay in memory.

    A document becomes up to ten rows of text, and 64 MB of packed input some gigabytes to sort. Splits and merged
    shuffle parts get smaller bounds, and shuffles start with a part for each ``PART_BYTES`` of the table. What the
    session sets itself stays, and small inputs keep their parts. Generated methods stay short enough to be compiled.
    """
    for name, value in {**SMALL_PARTS, **SHORT_METHODS}.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if input_bytes > least * PART_BYTES:
        spark.conf.set(first, str(-(-input_bytes // PART_BYTES)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    """One folder per local session; the setting itself cannot be changed while a session runs."""
    return tempfile.mkdtemp(prefix="dossier-")


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters and later columns reuse instead of computing it again.

    A predicate on a plain computed column is pushed below it and evaluates the
    whole expression once more; it is not pushed below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def explode_present(df: DataFrame, keep: Sequence[Column | str], items: Sequence[Column],
                    part: str | None = None, made: bool = False) -> DataFrame:
    """One row per non-null struct of ``items``, its fields as columns after ``keep``.

    Nulls are filtered after the generator: a filter on the array before it would
    make Spark evaluate every item twice. With ``made`` the items are a column before it, which suits many long
    items: Spark cuts what a projection computes into short methods, but not what a generator holds.
    """
    if made:
        listed = df.select(*keep, F.array(*items).alias("_items"))
        rows = listed.select(*[F.col(c) for c in listed.columns if c != "_items"], F.explode("_items").alias("_item"))
    else:
        rows = df.select(*keep, F.explode(F.array(*items)).alias("_item"))
    test = F.col("_item") if part is None else F.col(f"_item.{part}")
    return rows.filter(test.isNotNull()).select(*[c for c in rows.columns if c != "_item"], "_item.*")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later stages read columns with statistics instead of repeating the lineage,
    and a lost executor costs a re-read only.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``cut`` of rows dealt by ``key`` to ``parts`` parts, which stay so: joins and groups by ``key`` need not move them again.

    The table is written as buckets to the shared folder; its name is taken out of the catalog at once, the files stay.
    """
    name = f"cut_{uuid.uuid4().hex}"
    spark = df.sparkSession
    df.write.bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table

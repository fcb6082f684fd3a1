"""Mixing sources to target weights by systematic sampling.

Each source has a target in words. Every document of it expects target / source size copies; the expected
copies are summed along the source, one random offset is added, and a copy is emitted for each whole
number the sum crosses. Along the source documents stand by size, so the words taken
differ from the target by less than the largest document.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier.llm.common import SPACE, keeps_names
from dossier.session import cut

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 42


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``name``: 0, 1, 2 … per ``keys`` in ``order``, without a whole key in one task.

    Rows are dealt into ranges of (keys, order) that cut through large keys, numbered inside each range,
    and moved on by the number of earlier rows of the key: one small row per range and key.
    Which range a row falls into does not change its number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *[F.col(k).alias(f"_{k}") for k in keys],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_inside", F.row_number().over(inside))
    return numbered.join(offsets.withColumnRenamed("_part", "_part2"), (F.col("_part") == F.col("_part2"))
                         & _all_same(keys), "inner").select(
        *rows.columns, (F.col("_inside") - 1 + F.col("_before")).alias(name))


def _all_same(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return test


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from a table of ``source, source_size``.

    Sources by code point, nulls last, weigh ``weights`` in turn and share ``share`` times all words. No target
    passes ``most`` times its source's size; what is over is shared again by weight among the others, until
    none is above. Each round reads two sums from the table; a round that caps nothing ends it.
    """
    named = ranked(sources.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(named.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("most")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:
        open_, closed = F.when(~capped, F.col("weight")), F.when(capped, F.col("most"))
        weighed, used, n = rows.agg(F.sum(open_), F.coalesce(F.sum(closed), F.lit(0.0)), F.count_if(capped)).first()
        if not weighed:
            break
        level = (total - used) / weighed
        capped = F.col("most") < level * F.col("weight")
        if rows.agg(F.count_if(capped)).first()[0] == n:
            break
    return rows.select("source", "source_size", F.when(capped, F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, digest, size, source_size, target, copies`` for every row of ``docs``.

    ``copies`` is how often the mix takes the whole text, at most ``ceil(most)``. Null and empty texts have size
    zero; rows without a source are a source of their own; a source without words has target zero and
    no copies; ties of size stand by id and a digest of the text, and repeated rows are numbered one after
    the other, so reruns give the same copies. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                            F.xxhash64(text).alias("digest"), size_of(text).alias("size")))
    goal = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    # large before small: neighbours are alike, so what rounding takes from one the next gives back
    placed = ranked(sizes.withColumn("_size", -F.col("size")), ["source"], ["_size", "doc_id", "digest"], "place")
    rows = placed.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"))
    offset = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / 4294967296.0
    crossed = F.floor(offset + rate * (F.col("place") + 1)) - F.floor(offset + rate * F.col("place"))
    return rows.select("doc_id", "source", "digest", "size", "source_size", "target", crossed.cast("long").alias("copies"))


@keeps_names("copy")
def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            **how: object) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken, with ``copy`` counting from 1.

    A column of ``docs`` named ``copy`` is replaced. Repeated rows are told apart by a running number.
    """
    rows = mixed(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    keys = ("_id", "_digest", "_source")
    own = rows.select(F.col("doc_id").alias("_id2"), F.col("digest").alias("_digest2"), F.col("source").alias("_source2"),
                      F.col("copies").alias("_copies"),
                      F.row_number().over(Window.partitionBy("doc_id", "digest", "source").orderBy("copies")).alias("_n2"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumns({"_id": F.col(id_col).cast("long"), "_digest": F.xxhash64(text), "_source": F.col(source_col)})
    numbered = named.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_id")))
    same = F.col("_n") - F.col("_n2") == 0
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
    taken = numbered.join(own.filter("_copies > 0"), same)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))

"""Interaction audit of filters: what each filter removes at each step of every order.

Spark reduces the documents to counts per part and pattern of failed filters. A part's counts then form a tensor with one
axis of length two (pass, fail) for each filter, and every figure of every step is a contraction of it: the filters before
the step select pass, the filter of the step selects pass or fail, those after it select all.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import let, words
from dossier.session import cut, settle

# letter → failing condition; ``copy`` is true if a document of smaller id has the same text
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "has_symbol",
    "E": "copy",
}
LETTERS = "".join(FILTERS)
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_PARTS = 64  # parts contracted together, some 15 MB
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def measures(text: Column) -> Column:
    """What the conditions read, from one pass over the words of a text."""
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return let(counts, lambda c: F.struct(
        c["words"].cast("long").alias("n_words"), c["distinct"].cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"), F.length(text).cast("long").alias("n_chars"),
        text.rlike("[#$%&*|]").alias("has_symbol"), F.unhex(F.sha2(text, 256)).alias("digest")))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, fails`` for every row: bit k of ``fails`` is filter k of ``LETTERS``.

    A null text counts as empty, a null part as an empty string. A null id is not smaller than any and has none
    smaller, so its row never fails the test for copies; repeated rows of the least id are no copies either. The first
    of a group of copies meets its own digest and id in the join; the others, however many, are spread by their ids.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                              text.alias("text")), "_m", measures(F.col("text"))).select("doc_id", "part", "_m.*").drop("text")
    kept = cut(rows)
    named, nameless = kept.filter("doc_id IS NOT NULL"), kept.filter("doc_id IS NULL").withColumn("copy", F.lit(False))
    first = named.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first"))
    both = named.join(first, same, "left").withColumn("copy", F.col("_first").isNull()).drop("_digest", "_first").unionByName(nameless)
    bits = [F.when(F.expr(test), 1 << k).otherwise(0) for k, test in enumerate(FILTERS.values())]
    return both.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"))


def cells(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and pattern: all, those labelled good and those labelled toxic.

    A document labelled more than once is good (toxic) if any row says so; null ids have no label.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    marked = fails.filter("doc_id IS NOT NULL").join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "fails", "good", "toxic")
    none = F.lit(None).cast("boolean")
    marked = marked.unionByName(fails.filter("doc_id IS NULL").select("part", "fails", none.alias("good"), none.alias("toxic")))
    return marked.groupBy("part", "fails").agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


@cache
def selectors(letters: str = LETTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The steps of all orders, and for each figure the (steps, filters, 2) choice of pass, fail or all on each axis."""
    steps = [("".join(order), k) for order in permutations(letters) for k in range(len(letters))]

    def choose(before: tuple, this: tuple, after: tuple) -> np.ndarray:
        return np.array([[this if order.index(x) == k else before if order.index(x) < k else after for x in letters]
                         for order, k in steps], np.int64)

    return steps, {"kept": choose(_PASS, _PASS, _ALL), "removed": choose(_PASS, _FAIL, _ALL),
                   "failing": choose(_ALL, _FAIL, _ALL), "unique": choose(_PASS, _FAIL, _PASS)}


def contract(tensor: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """(parts, 2, …, 2) counts and (steps, filters, 2) choices → (parts, steps) sums."""
    axes = "abcdefghijklm"[:choice.shape[1]]
    terms = ",".join([f"p{axes}", *[f"s{a}" for a in axes]])
    return np.einsum(f"{terms}->ps", tensor, *[choice[:, k] for k in range(len(axes))], optimize="greedy")


def figures(counts: np.ndarray, letters: str = LETTERS) -> dict[str, np.ndarray]:
    """All figures, each (parts, steps), of (parts, 3, patterns) counts: all, good and toxic documents."""
    steps, choice = selectors(letters)
    # bit k of a pattern is axis k, so the axes come out in reverse order
    shape = (len(counts), 3, *[2] * len(letters))
    cube = counts.reshape(shape).transpose(0, 1, *range(len(letters) + 1, 1, -1))
    every, good, toxic = cube[:, 0], cube[:, 1], cube[:, 2]
    removed = contract(every, choice["removed"])
    which = np.array([letters.index(order[k]) for order, k in steps])
    shared = np.stack([removed[:, which == x].sum(axis=1) for x in range(len(letters))], axis=1)
    return {"kept": contract(every, choice["kept"]), "removed": removed, "redundant": contract(every, choice["failing"]) - removed,
            "unique_fails": contract(every, choice["unique"]), "good_lost": contract(good, choice["removed"]),
            "toxic_lost": contract(toxic, choice["removed"]), "shapley": shared[:, which]}


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``cells``: at most 32 patterns a part meet in its row."""
    size = 1 << len(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = selectors()[0]
        for whole in batches:
            for start in range(0, whole.num_rows, _PARTS):
                batch = whole.slice(start, _PARTS)
                tensor = np.zeros((batch.num_rows, 3, size), np.int64)
                for row, patterns in enumerate(batch.column(1).to_pylist()):
                    for x in patterns:
                        tensor[row, :, x["fails"]] = x["docs"], x["good"], x["toxic"]
                part = [p for p in batch.column(0).to_pylist() for _ in steps]
                order, step = [s[0] for s in steps] * batch.num_rows, [s[1] + 1 for s in steps] * batch.num_rows
                arrays = {"part": pa.array(part, pa.string()), "filter_order": pa.array(order, pa.string()), "step": pa.array(step, pa.int32())}
                arrays |= {name: pa.array(values.ravel(), pa.int64()) for name, values in figures(tensor).items()}
                yield pa.RecordBatch.from_pydict(arrays)

    patterns = F.collect_list(F.struct("fails", "docs", "good", "toxic")).alias("patterns")
    return counts.groupBy("part").agg(patterns).mapInArrow(run, RESULT)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents; other columns are not read, an empty table gives no rows."""
    return audit(cells(failures(docs), labels))

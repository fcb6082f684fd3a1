"""Line dedup over content-defined chunks of lines, by Spark expressions only.

A rolling hash over the hashes of neighbouring lines ends a chunk, so boundaries move with the content and
a line put in front of a passage shifts none of them. Chunks of several lines that stand
elsewhere too, compared byte for byte, stay only where they stand first (``without_repeats``). A chunk that
lies only partly in a shared passage differs and stays, so short passages mostly do.

``without_passages`` has no chunks: every two neighbouring lines are a unit, so that a passage of two lines or
more goes wherever it starts and ends.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import keeps_names, let
from dossier.session import cut

DIVISOR = 4  # lines per chunk on average
_NO_ID = -2**63


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """The chunks of a text: an array of number, lines and text, which joined by line feeds give it back."""
    def of(lines: Column, hashes: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == F.size(lines) - 1) | F.coalesce(
            (31 * F.get(hashes, i - 1) + F.get(hashes, i)) % divisor == 0, F.lit(False)))

        def chunk(e: Column, cuts: Column, k: Column) -> Column:
            start = F.coalesce(F.get(cuts, k - 1) + 1, F.lit(0))
            return F.struct(k.alias("no"), (e - start + 1).alias("lines"),
                            F.array_join(F.slice(lines, start + 1, e - start + 1), "\n").alias("text"))

        return let(ends, lambda cuts: F.transform(cuts, lambda e, k: chunk(e, cuts, k)))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(lines, lambda s: let(F.transform(s, _line_hash), lambda h: of(s, h)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.hash(text).alias("_digest"),
                       text.alias("_text"))


def repeats(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _digest, _gone``: the numbers of the chunks to remove, for the rows that have any.

    Texts of chunks are the grouping key of the first shuffle, which is the comparison of bytes; copies
    inside a task collapse before it. Only digests and places are joined afterwards; should one digest stand
    for two texts, none of them is removed.
    """
    each = _rows(docs, id_col, text_col).select("_id", "_digest", F.explode(chunks(F.col("_text"), divisor)).alias("c"))
    several = each.filter((F.col("c.lines") > 1) & F.col("c.text").rlike(r"\S"))
    place = F.struct("_id", "_digest", F.col("c.no").alias("no"))
    texts = several.groupBy(F.col("c.text").alias("text")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    known = cut(texts.filter("n > 1").select(F.md5("text").alias("key"), "first").groupBy("key").agg(
        F.count("*").alias("texts"), F.min("first").alias("first")).filter("texts = 1").select("key", "first"))
    found = several.select(F.md5("c.text").alias("key"), place.alias("at")).join(known, "key")
    return found.filter(F.col("at") != F.col("first")).groupBy("at._id", "at._digest").agg(
        F.collect_set("at.no").alias("_gone"))


@keeps_names("_before", "_after")
def without_repeats(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, the text without repeated chunks, and ``_before`` and ``_after``:
    struct of chunks and lines of the text as given and as left.

    The first place is the least by id, text digest and chunk number; rows without an id come first. Rows equal
    in id and text are one document and are treated alike. Null texts stay null, empty ones empty; single
    lines and blank chunks are never removed; columns named like the two added ones are replaced.
    """
    gone = repeats(docs, divisor, id_col, text_col).withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns(
        {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "_digest": F.hash(text)})
    both = rows.join(gone, (F.col("_id") == F.col("_id2")) & (F.col("_digest") == F.col("_digest2")), "left")
    none = F.expr("cast(array() as array<int>)")

    def left(all_: Column) -> Column:
        numbers = F.array_except(F.transform(all_, lambda c: c["no"]), F.coalesce("_gone", none))
        kept = F.transform(numbers, lambda k: F.get(all_, k))
        count = lambda a: F.aggregate(a, F.lit(0), lambda n, c: n + c["lines"])
        return let(kept, lambda k: F.struct(
            F.array_join(F.transform(k, lambda c: c["text"]), "\n").alias("text"),
            F.struct(F.size(all_).alias("chunks"), count(all_).alias("lines")).alias("before"),
            F.struct(F.size(k).alias("chunks"), count(k).alias("lines")).alias("after")))

    done = both.withColumn("_done", F.explode(F.array(let(chunks(F.col(text_col), divisor), left))))
    new_text = F.when(F.col(text_col).isNotNull(), F.col("_done.text")).alias(text_col)
    return done.select(*[new_text if c == text_col else F.col(c) for c in docs.columns],
                       F.col("_done.before").alias("_before"), F.col("_done.after").alias("_after"))


def _pairs(text: Column) -> Column:
    """Units of a text: each line that is not blank with the next such one and the blank lines between, as array of
    start, end and text."""
    def of(lines: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\S"))
        return let(full, lambda at: F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda s, k: F.struct(
            s.alias("start"), F.get(at, k + 1).alias("end"),
            F.array_join(F.slice(lines, s + 1, F.get(at, k + 1) - s + 1), "\n").alias("text"))))

    return let(F.split(text, "\n"), of)


@keeps_names("_before", "_after")
def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, the text without the passages of two and more lines that stand at an
    earlier place, and ``_before`` and ``_after``: struct of lines of the text as given and as left.

    A unit of two lines stays at its least place by id, text digest and line number and goes, with both lines, at all
    others; a longer passage is a run of such units. The first place of a line is never removed, since a line
    goes only for an earlier one. Texts of units are the grouping key, which is the comparison of bytes.
    Blank lines go only between two lines that go together. Rows without an id, repeated rows, null texts and columns
    named like the added ones are treated as in ``without_repeats``.
    """
    units = _rows(docs, id_col, text_col).select("_id", "_digest", F.explode(_pairs(F.col("_text"))).alias("u"))
    place = F.struct("_id", "_digest", F.col("u.start").alias("start"))
    texts = units.groupBy(F.col("u.text").alias("text")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    known = cut(texts.filter("n > 1").select(F.md5("text").alias("key"), "first").groupBy("key").agg(
        F.count("*").alias("texts"), F.min("first").alias("first")).filter("texts = 1").select("key", "first"))
    found = units.select(F.md5("u.text").alias("key"), place.alias("at"), F.col("u.end").alias("end")).join(known, "key")
    gone = found.filter(F.col("at") != F.col("first")).groupBy(F.col("at._id").alias("_id2"), F.col("at._digest").alias("_digest2")).agg(
        F.collect_set(F.struct("at.start", "end")).alias("_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns(
        {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "_digest": F.hash(text)})
    both = rows.join(gone, (F.col("_id") == F.col("_id2")) & (F.col("_digest") == F.col("_digest2")), "left")

    def left(lines: Column) -> Column:
        out = F.flatten(F.transform("_gone", lambda u: F.sequence(u["start"], u["end"])))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
        return let(kept, lambda k: F.struct(
            F.array_join(F.transform(k, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.struct(F.size(lines).alias("lines")).alias("before"), F.struct(F.size(k).alias("lines")).alias("after")))

    same = F.size(F.split(text, "\n"))
    whole = F.struct(text.alias("text"), F.struct(same.alias("lines")).alias("before"), F.struct(same.alias("lines")).alias("after"))
    done = both.withColumn("_done", F.explode(F.array(
        F.when(F.col("_gone").isNull(), whole).otherwise(let(F.split(text, "\n"), left)))))
    new_text = F.when(F.col(text_col).isNotNull(), F.col("_done.text")).alias(text_col)
    return done.select(*[new_text if c == text_col else F.col(c) for c in docs.columns],
                       F.col("_done.before").alias("_before"), F.col("_done.after").alias("_after"))

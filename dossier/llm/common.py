"""Column helpers shared by the operators: words, let-bindings, row identity."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \\t-\\r"  # inside a character class: the white space that separates words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once; a plain expression would be repeated at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(name: str, text: str) -> Column:
    """Identity of a row: its id, which may be null or repeated, and a digest of its text.

    Rows equal in both are repeats of one document and get one decision.
    """
    return F.struct(F.col(name).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"))


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, whatever else the table holds, with a null text as an empty one."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keeps_names(*added: str) -> Callable:
    """For operators that return all columns of their rows: those whose names begin with an underscore, as the operator's
    own do, are renamed on the way in and back on the way out; those named like ``added`` are replaced."""
    def around(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(run)
        def apart(docs: DataFrame, *args: object, **how: object) -> DataFrame:
            docs = docs.drop(*added)
            width = max(map(len, docs.columns))
            aside = {c: f"{k}".rjust(width + 1, "c") for k, c in enumerate(docs.columns) if c.startswith("_")}
            if not aside:
                return run(docs, *args, **how)
            name = lambda v: aside.get(v, v) if isinstance(v, str) else v
            done = run(docs.withColumnsRenamed(aside), *map(name, args), **{k: name(v) for k, v in how.items()})
            return done.withColumnsRenamed({v: k for k, v in aside.items()})

        return apart

    return around

"""Rule ledger: every quality rule evaluated once per document, kept as bits beside the measurements.

A policy is a mask over the bits. Changing it, comparing versions or asking what one rule
costs (ablation) reads the ledger and never the texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import SPACE, let, words
from dossier.session import settle

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words",
            "n_stutter_words")
# name → failing condition over the measurements; the position in this mapping is the bit
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "capital_words": "100 * n_caps_words > 50 * n_words",
    "stuttered_words": "100 * n_stutter_words > 30 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
# versioned policies: which rules reject
POLICIES = {"base": BASE, "v1": BASE | BITS["many_symbols"] | BITS["duplicate_lines"], "v2": sum(BITS.values())}
PRODUCTION = "v2"


def _repeat_words(w: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the array ``w``.

    Window digests are sorted beside their positions; equal neighbours are compared word by word.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, WINDOW) == F.slice(w, b["i"] + 1, WINDOW))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))
                     | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda acc, x: F.struct(
            (acc["n"] + x + WINDOW - F.greatest(x, acc["end"])).alias("n"), (x + WINDOW).alias("end")))["n"]

    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) < WINDOW + 1, 0).otherwise(repeated)


def measures(text: Column) -> Column:
    """Struct of all measurements of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    in_lines = let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("d")))
    caps = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"

    def of(w: Column, s: Column) -> Column:
        stutter = F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))
        values = (F.size(w), F.length(F.array_join(w, "")), F.regexp_count(text, F.lit("[#*$%&|<>]")), s["n"], s["d"],
                  _repeat_words(w), F.size(F.filter(w, lambda x: x.rlike(caps))), F.size(stutter))
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(MEASURES, values)])

    return let(words(text), lambda w: let(in_lines, lambda s: of(w, s)))


def fail_bits(measured: Column) -> Column:
    """The failed rules of a struct of measurements as one number."""
    low = {n: measured[n] for n in MEASURES}
    tests = (
        low["n_words"] < 20,
        100 * low["n_repeat_words"] > 30 * low["n_words"],
        100 * low["n_symbols"] > 10 * low["n_words"],
        100 * low["n_dup_lines"] > 40 * low["n_lines"],
        100 * low["n_caps_words"] > 50 * low["n_words"],
        100 * low["n_stutter_words"] > 30 * low["n_words"],
    )
    bits = F.lit(0).cast("long")
    for k, test in enumerate(tests):
        bits = bits + F.when(test, F.lit(1 << k)).otherwise(F.lit(0))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, measurements, ``fail_bits``.

    Null and empty texts have zero measurements and fail ``too_few_words``; repeated rows and null ids
    give rows of their own; other columns are not read; an empty table gives an empty ledger.
    """
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "_m", measures(F.col("text")))
    return rows.select("doc_id", "_m.*", fail_bits(F.col("_m")).alias("fail_bits"))


def judged(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with ``kept`` under a policy version."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(POLICIES[policy]) == 0)


def ablation(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay if it is left out.

    The ledger is first counted per bit pattern, of which there are at most two to the number of rules.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit"))
                                for n, b in BITS.items() if mask & b]))
    each = patterns.select("bits", "n", rules.alias("_r")).select("bits", "n", "_r.*")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"),
        F.coalesce(F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n"))),
                   F.lit(0)).alias("kept_without"))


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that a policy keeps."""
    return docs.filter(let(measures(F.col(text_col)), lambda m: fail_bits(m).bitwiseAND(POLICIES[policy]) == 0))

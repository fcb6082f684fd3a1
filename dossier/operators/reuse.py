"""Evidence submitted more than once: exact copies, near copies, matching features."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossier.functions.shapes import cosine, hamming
from dossier.functions.text import search_words
from dossier.operators.listing import top_n_within
from dossier.session import cut

NEAR_BITS = 8
BITS = 64
SPARE = 4  # blocks that two near hashes share at least


def same_hash(docs: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Documents whose hash occurs elsewhere: copies, other cases, and the first two holders.

    A group of copies is described by aggregates instead of its pairs, so a
    third of all rows may share one hash. Long hashes are counted as numbers first:
    only what shares its number with another row, all true copies among it, is
    grouped by the hash itself.
    """
    marked = docs.filter(F.coalesce(hash_col, F.lit("")) != "").withColumn("_mark", F.xxhash64(hash_col))
    twice = cut(marked.groupBy("_mark").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_mark"))
    held = marked.join(twice, "_mark", "left_semi").drop("_mark")
    at = F.struct("document_id", "case_id")
    groups = held.groupBy(hash_col).agg(
        F.count("*").alias("copies"), F.min(at).alias("first"), F.max(at).alias("last")).filter(F.col("copies") > 1)
    other = F.when(F.col("document_id") == F.col("first.document_id"), F.col("last")).otherwise(F.col("first"))
    return held.join(groups, hash_col).select(
        "document_id", "case_id", hash_col, (F.col("copies") - 1).alias("hits"),
        other["document_id"].alias("other_document_id"), other["case_id"].alias("other_case_id"),
        (other["case_id"] == F.col("case_id")).alias("same_case"))


def reuse_rows(exact: DataFrame) -> DataFrame:
    """The validation row of each reused document, in words."""
    more = F.col("hits") - 1
    text = F.concat(
        F.lit("Potential reuse detected — this document appears identical file (case #"),
        F.col("other_case_id").cast("string"), F.lit(")"),
        F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more match(es).")))
        .otherwise("."))
    return exact.select("case_id", "document_id", F.lit("Duplicate / reuse").alias("check_type"),
                        F.lit("warning").alias("status"), text.alias("message"))


def listed_hits(docs: DataFrame, hash_col: str = "file_hash", most: int = 5) -> DataFrame:
    """For each reused document the first ``most`` other documents with its hash, by id, as ``rank`` 1, 2, …

    One more than that is kept per hash, so a document among the first of them still finds enough others; a group
    of copies never meets itself whole.
    """
    held = docs.filter(F.coalesce(hash_col, F.lit("")) != "").select(hash_col, "document_id", "case_id")
    first = top_n_within(held, [hash_col], [F.col("document_id")], most + 1).select(
        hash_col, F.col("document_id").alias("other_document_id"), F.col("case_id").alias("other_case_id"), "rank")
    # ids before the own one keep their place, those after it move up by one
    rank = F.col("rank") - (F.col("document_id") < F.col("other_document_id")).cast("int")
    return held.join(first, hash_col).filter(F.col("document_id") != F.col("other_document_id")).withColumn(
        "rank", rank.cast("int")).filter(F.col("rank") <= most)


def with_simhash(texts: DataFrame, col: str = "text", name: str = "near_hash") -> DataFrame:
    """Fingerprint of each text; computed once per distinct text hash by the caller if copies are many."""
    # one binary a text: a list would reach Python as an object for each word
    votes = texts.withColumn("_hashes", F.unhex(F.array_join(F.transform(
        search_words(col), lambda w: F.substring(F.sha2(w, 256), 1, 16)), "")))
    return votes.withColumn(name, _votes(F.col("_hashes"))).drop("_hashes")


@F.pandas_udf(T.LongType())
def _votes(hashes: pd.Series) -> pd.Series:
    """Majority of each bit over the 8-byte hashes of a text, which stand one behind the other; vectorised per text."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for row, items in enumerate(hashes):
        if items is None or len(items) == 0:
            continue
        rows = np.frombuffer(items, dtype=np.uint8).reshape(-1, 8)
        majority = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64) * 2 > len(rows)
        out[row] = weights[majority].sum(dtype=np.uint64)
    return pd.Series(out.view(np.int64))


def blocks_of(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks over 64 bits."""
    at = [BITS * k // count for k in range(count + 1)]
    return [(low, high - low) for low, high in zip(at, at[1:])]


def _mask(low: int, width: int) -> int:
    """The bits of a block as a signed number."""
    bits = (1 << low + width) - (1 << low)
    return bits - (1 << BITS) if bits >> BITS - 1 else bits


def indexed(hashes: DataFrame, bits: int = NEAR_BITS, spare: int = SPARE) -> DataFrame:
    """``h, key`` for each hash ``h`` and each choice of ``spare`` of its ``bits`` + ``spare`` blocks.

    Two hashes that differ in at most ``bits`` bits differ in at most as many blocks, so all blocks of some choice agree.
    The key has a bit for each chosen block on top and a digest of what they hold below.
    """
    blocks = blocks_of(bits + spare)
    choices = [(sum(1 << b for b in chosen), sum(_mask(*blocks[b]) for b in chosen)) for chosen in combinations(range(len(blocks)), spare)]
    # one constant of the plan; an array of as many column objects would be slow to build
    codes, masks = (F.split(F.lit(" ".join(str(x[k]) for x in choices)), " ").cast("array<bigint>") for k in (0, 1))
    each = F.explode(F.arrays_zip(codes.alias("blocks"), masks.alias("mask")))
    low = BITS - len(blocks)
    top, digest = F.shiftleft("c.blocks", low), F.xxhash64(F.col("h").bitwiseAND(F.col("c.mask")))
    return hashes.select("h", each.alias("c")).select("h", top.bitwiseOR(F.shiftrightunsigned(digest, len(blocks))).alias("key"))


def _first_choice(key: Column, a: Column, b: Column, bits: int, spare: int) -> Column:
    """Whether ``key`` is the lowest choice of blocks in which two hashes agree: a pair comes out there, once.

    The blocks that agree, up to the highest chosen one, must be the chosen ones.
    """
    blocks = blocks_of(bits + spare)
    differ = a.bitwiseXOR(b)
    agree = F.lit(0).cast("long")
    for number, block in enumerate(blocks):
        agree = agree.bitwiseOR(F.when(differ.bitwiseAND(F.lit(_mask(*block)).cast("long")) == 0, F.lit(1 << number)).otherwise(F.lit(0)))
    chosen = F.shiftrightunsigned(key, BITS - len(blocks))
    upto = chosen
    for step in (1, 2, 4, 8):
        upto = upto.bitwiseOR(F.shiftrightunsigned(upto, step))
    return agree.bitwiseAND(upto) == chosen


def _distinct_hashes(docs: DataFrame, hash_col: str) -> DataFrame:
    return docs.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(
        F.count("*").alias("n"), F.min("document_id").alias("document_id"))


def near_hash(docs: DataFrame, hash_col: str = "near_hash", bits: int = NEAR_BITS, spare: int = SPARE) -> DataFrame:
    """Pairs of *distinct* hashes that differ in at most ``bits`` bits, with their documents counted.

    Distinct hashes are counted first, so copies cost nothing. Each is indexed under every choice of ``spare`` of its
    ``bits`` + ``spare`` blocks (495 keys of some 21 bits); hashes that share a key are compared inside the join, and a pair
    comes out at its first shared key only. No pair is left out, and the path is one for all sizes. A higher ``spare``
    makes longer keys and fewer comparisons for more index rows (``near_cost``).
    """
    distinct = cut(_distinct_hashes(docs, hash_col))
    left = indexed(distinct, bits, spare).withColumnRenamed("h", "hash_a")
    right = indexed(distinct, bits, spare).withColumnRenamed("h", "hash_b")
    a, b = F.col("hash_a"), F.col("hash_b")
    near = (a < b) & (hamming("hash_a", "hash_b") <= bits)
    # Spark does not know how many rows an index has and would broadcast one
    pairs = left.join(right.hint("merge"), "key").filter(near & _first_choice(F.col("key"), a, b, bits, spare)).select("hash_a", "hash_b")
    of_a = distinct.select(F.col("h").alias("hash_a"), F.col("document_id").alias("document_a"),
                           F.col("n").alias("copies_a"))
    of_b = distinct.select(F.col("h").alias("hash_b"), F.col("document_id").alias("document_b"), F.col("n").alias("copies_b"))
    return pairs.join(of_a, "hash_a").join(of_b, "hash_b").withColumn("distance", hamming("hash_a", "hash_b"))


def near_cost(docs: DataFrame, hash_col: str = "near_hash", bits: int = NEAR_BITS, spare: int = SPARE) -> DataFrame:
    """What ``near_hash`` will do: distinct hashes, index rows, pairs compared, and the most rows under one key."""
    keys = indexed(_distinct_hashes(docs, hash_col), bits, spare).groupBy("key").agg(F.count("*").alias("m"))
    choices = comb(bits + spare, spare)
    return keys.agg((F.coalesce(F.sum("m"), F.lit(0)) / choices).cast("long").alias("hashes"),
                    F.coalesce(F.sum("m"), F.lit(0)).alias("index_rows"),
                    F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("compared"),
                    F.coalesce(F.max("m"), F.lit(0)).alias("largest"))


# ---- feature vectors -----------------------------------------------------------------

def feature_match(vectors: DataFrame, key: str = "case_id", match: int = 70, borderline: int = 50) -> DataFrame:
    """Likeness of the feature vectors of a case, for cases of a few vectors each.

    ``vectors``: key, vec_id, embedding. Equal vectors are counted together. Vectors
    travel in tiles of bounded arrays; pairs of tiles are compared in the JVM and
    counted by outcome there, so pairs themselves are never rows.
    """
    distinct = vectors.groupBy(key, "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    distinct = cut(distinct)
    sizes = distinct.groupBy(key).agg(F.sum("n").alias("n_vectors"), F.count("*").alias("_v"))
    tile = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("_v") / 64)).cast("int")
    tiles = distinct.join(sizes, key).groupBy(key, tile.alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "n", "embedding"))).alias("items"))
    right = tiles.select(key, F.col("tile").alias("tile_b"), F.col("items").alias("items_b"))
    met = tiles.join(right, key).filter(F.col("tile") <= F.col("tile_b"))
    own = F.col("tile") == F.col("tile_b")

    def outcomes(a: Column) -> Column:
        def one(b: Column) -> Column:
            score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(
                cosine(a["embedding"], b["embedding"]) * 100, 0).cast("int")))
            pairs = F.when(own & (a["vec_id"] == b["vec_id"]), a["n"] * (a["n"] - 1) / 2) \
                .otherwise(a["n"] * b["n"].cast("double"))
            return F.struct(score.alias("score"), pairs.alias("pairs"))

        kept = F.filter(F.col("items_b"), lambda b: ~own | (b["vec_id"] >= a["vec_id"]))
        return F.transform(kept, one)

    scored = F.flatten(F.transform(F.col("items"), outcomes))

    def count(low: int, high: int) -> Column:
        return F.aggregate(F.col("_s"), F.lit(0.0), lambda t, s: t + F.when(
            (s["score"] >= low) & (s["score"] < high), s["pairs"]).otherwise(0.0))

    tallied = met.select(key, scored.alias("_s")).select(
        key, count(match, 101).alias("matches"), count(borderline, match).alias("borderlines"),
        count(0, borderline).alias("mismatches"))
    summed = tallied.groupBy(key).agg(*[F.sum(c).cast("long").alias(c)
                                        for c in ("matches", "borderlines", "mismatches")])
    status = (F.when(F.col("n_vectors") == 1, "single_face").when(F.col("mismatches") > 0, "mismatch")
              .when(F.col("borderlines") > 0, "borderline").otherwise("match"))
    return sizes.drop("_v").join(summed, key).withColumn("status", status)


def face_findings(matched: DataFrame, key: str = "case_id") -> DataFrame:
    """Finding rows of the vector comparison: one per outcome, with the number of pairs behind it."""
    rows = F.array(
        F.struct(F.lit("high").alias("severity"), F.col("mismatches").alias("pairs")),
        F.struct(F.lit("medium").alias("severity"), F.col("borderlines").alias("pairs")),
        F.struct(F.lit("info").alias("severity"), F.col("matches").alias("pairs")))
    return matched.select(F.col(key).alias("case_id"), F.lit("facial_photo").alias("field_name"),
                          F.explode(rows).alias("r")).select("case_id", "field_name", "r.*").filter("pairs > 0")


_FACE_TEXT = {"high": "Photos show different people", "medium": "Photos are too unlike to be sure of one person",
              "info": "Photos show the same person"}


def face_rows(findings: DataFrame) -> DataFrame:
    """Photo findings (case_id, severity, pairs) in the shape of consistency findings; ``pairs`` is what a row counts for."""
    severity = F.col("severity")
    words = F.when(severity == "high", _FACE_TEXT["high"]).when(severity == "medium", _FACE_TEXT["medium"]).otherwise(_FACE_TEXT["info"])
    none = F.lit(0).cast("long")
    return findings.select(
        "case_id", F.lit("facial_photo").alias("field_name"), F.lit("").alias("type_key"), "severity",
        none.alias("n_documents"), none.alias("n_clusters"),
        F.concat(words, F.lit(" in "), F.col("pairs").cast("string"), F.lit(" pair(s) of documents.")).alias("explanation"), "pairs")

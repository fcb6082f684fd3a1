"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into fewer segments than the allowed difference plus one, so that two linked
fingerprints have a segment that differs by one bit at most. Every segment is indexed once per
bit with that bit left out; an equality join on these variants meets every such pair, and the whole
fingerprints verify it. Copies collapse to one fingerprint first.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dossier.session import cut

SHINGLE, BITS, SEGMENTS, SEED = 4, 4, 3, 42
ROUND = 16
SENT_ROWS = 1 << 18  # rows that a round may broadcast, some 50 bytes each
_CHUNK = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingle digests, as a signed number; no words give zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(last), _CHUNK):
        spans = zip(starts[k:k + _CHUNK].tolist(), last[k:k + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print`` for every row; null and empty texts have print zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = [fingerprint(t.lower().split(), shingle) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, print long")


def _bounds(segments: int) -> list[tuple[int, int]]:
    at = [64 * s // segments for s in range(segments + 1)]
    return list(zip(at, at[1:]))


def _mask(low: int, high: int) -> int:
    return ((1 << high) - 1) ^ ((1 << low) - 1)


def variants(items: DataFrame, prints: Sequence[str], segments: int, wild: bool = True) -> DataFrame:
    """One row per item, print and bit: the bit's segment with that bit left out, as ``key``.

    The key holds the number of the bit above 32 bits of the segment. Where not ``wild``, one row per item, print and
    segment: the whole segment, under the number of its first bit.
    """
    keys = [F.shiftleft(F.lit(64 * p + b).cast("long"), 32).bitwiseOR(
        F.shiftrightunsigned(F.col(name), lo).bitwiseAND(F.lit(_mask(0, hi - lo) & ~(wild << b - lo))))
            for p, name in enumerate(prints) for lo, hi in _bounds(segments) for b in (range(lo, hi) if wild else [lo])]
    return items.select("*", F.explode(F.array(*keys)).alias("key"))


def _differing(prints: Sequence[str]) -> Column:
    return reduce(add, [F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in prints])


def _first_meeting(prints: Sequence[str], segments: int, wild: bool = True) -> Column:
    """True in just one of the variants that two items share: the first in which they can meet.

    Both keys stand in the test, though they are equal: with one, Spark would filter that side before its shuffle,
    and the sides of a self-join could no longer share one.
    """
    first = F
    for p, name in enumerate(prints):
        differ = F.col(f"a.{name}").bitwiseXOR(F.col(f"b.{name}"))
        for lo, hi in _bounds(segments):
            part = F.shiftrightunsigned(differ, lo).bitwiseAND(F.lit(_mask(0, hi - lo)).cast("long"))
            bit = 64 * p + lo + F.when(part == 0, 0).otherwise(F.bit_count(part - 1))
            first = first.when(F.bit_count(part) <= int(wild), bit)
    return F.shiftrightunsigned(F.col("a.key").bitwiseOR(F.col("b.key")), 32) == first


def _met(a: DataFrame, b: DataFrame, test: Column, few: bool) -> DataFrame:
    """Pairs of variants of one key; ``few`` rows of ``b`` are sent to all tasks, else both sides are dealt and sorted.

    Spark sizes the variants as the items they come from, up to 64 rows a print too low, and left to itself would collect
    them in the driver.
    """
    return a.join(F.broadcast(b) if few else b.hint("merge"), (F.col("a.key") == F.col("b.key")) & test)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node reachable) for the nodes of the edges ``u, v``.

    Alternating large and small stars: each round hangs neighbours on smaller nodes until only stars are
    left. Rounds are written tables; only their count and digest reach the driver.
    """
    at = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        state = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == before or not state[0]:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("m", F.explode(F.array("u", "v")).alias("u"))
        at = cut(small.filter("u != m").select("u", F.col("m").alias("v")).distinct())


def _named(items: DataFrame, roots: DataFrame) -> DataFrame:
    """``items`` with the roots of a later step in place of ``root``; a written table."""
    moved = items.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    return cut(moved.withColumn("root", F.coalesce("_top", "root")).select(*items.columns))


def linked(items: DataFrame, prints: Sequence[str] = ("node",), bits: int = BITS, segments: int = SEGMENTS,
           verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, root`` for items of a distinct ``node`` and the columns ``prints``.

    Two items link where their prints together differ by at most ``bits``, one of the ``segments`` of a print differs by
    one bit at most (sure where ``bits`` is below twice the number of all segments), and ``verify``, which filters
    pairs ``u, v`` of nodes, keeps them. Items of different components meet in rounds: with one in 16 to some power,
    one in a 16th of that, and in the end with all, the power being such that the first round has fewer than 16 to
    meet. So the members of a dense group find together through few links. Only the last round must leave no link
    between components untried, and it alone indexes variants; those before meet in whole segments, which are a
    sixteenth of the rows or less. Links inside a component need not be looked at. Rounds of few are sent to all tasks.
    """
    if segments < 2:
        raise ValueError("a segment has 32 bits at most")
    # an item is a few bytes and becomes up to 64 rows a print: few files would be few tasks
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = cut(items.withColumn("root", F.col("node")))
    share, count = 1, named.count()
    while count >= share * ROUND:
        share *= ROUND
    while share:
        last = share == 1
        again = named.repartition(spread, "node")
        some = again if last else again.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
        a, b = variants(again, prints, segments, last).alias("a"), variants(some, prints, segments, last).alias("b")
        test = (F.col("a.root") != F.col("b.root")) & (_differing(prints) <= bits) & _first_meeting(prints, segments, last)
        if last:
            test = test & (F.col("a.node") < F.col("b.node"))
        few = not last and some.count() * segments * len(prints) <= SENT_ROWS
        pairs = _met(a, b, test, few)
        if verify:
            pairs = verify(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.root").alias("ru"),
                                        F.col("b.root").alias("rv")))
            edges = pairs.select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        else:
            edges = pairs.select(F.col("a.root").alias("u"), F.col("b.root").alias("v"))
        named = _named(named, components(edges))
        share //= ROUND
    return named.select("node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links of at most ``bits`` differing bits reach. Null and empty
    texts share print zero; repeated rows stay; null ids never name a component unless all its ids are
    null; other columns are not read; an empty table gives no rows.
    """
    if 2 * segments <= bits:
        raise ValueError("segments must leave one that differs by one bit at most")
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    of = linked(prints.select(F.col("print").alias("node")).distinct(), ("node",), bits, segments).withColumnRenamed(
        "node", "print")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("low")).join(of, "print")
    named = least.groupBy("root").agg(F.min("low").alias("component_id")).join(least.select("root", "print"), "root")
    return prints.join(named.select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """Distinct digests of the shingles; fewer words than a shingle are one, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())),
                                 np.uint64, len(last)))


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Digests of another, independent print: the first print takes them as they are."""
    if not number:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """Majority bits as a signed number; zero where there are none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k:k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _sketched(docs: DataFrame, shingle: int, prints: int) -> DataFrame:
    """``row, doc_id, text`` of every row with the digest of its words and ``prints`` prints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, made = [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").lower().split()
                hashes = shingle_hashes(words, shingle)
                marks.append(xxhash.xxh128_digest(b" ".join(words)))
                made.append([majority(_remixed(hashes, k)) for k in range(prints)])
            columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(prints)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary()), *columns],
                                             names=[*batch.schema.names, "mark", *[f"p{k}" for k in range(prints)]])

    schema = "row long, doc_id long, text binary, mark binary, " + ", ".join(f"p{k} long" for k in range(prints))
    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the rows ``node, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                nodes.append(node)
                sets.append(shingle_hashes((text.as_py() or b"").lower().split(), shingle).view(np.int64))
                held += len(sets[-1])
                if held > 16 * _CHUNK:
                    yield _packed(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield _packed(nodes, sets)

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _packed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], names=["node", "shingles"])


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 28, segments: int = 4,
            prints: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``: documents whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    A pair is a candidate where its ``prints`` independent prints together differ by ``bits`` at most and one segment of one
    print by one bit at most; every candidate between different components is verified on the whole sets, so no pair
    below the similarity links. A pair above it is missed only where no segment is that near: never up to 15 differing
    bits of 128, by chance beyond (at 0.8, where 19 bits differ in the mean, 7 in 100). Texts of the same words are one item; null and
    empty texts are one item too and resemble nothing else. Ids are treated as in ``near_duplicates``.
    """
    names = [f"p{k}" for k in range(prints)]
    rows = cut(_sketched(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")),
                         shingle, prints))
    items = cut(rows.groupBy("mark").agg(F.min("row").alias("node"), *[F.first(n).alias(n) for n in names]))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = cut(shingle_sets(rows.select(F.col("row").alias("node"), "text").join(nodes, "node", "left_semi"), shingle))
        a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "uv")
        common = F.size(F.array_intersect("su", "sv"))
        return pairs.join(a, "u").join(b, "v").filter(
            common / (F.size("su") + F.size("sv") - common) >= similarity).select(*pairs.columns)

    roots = linked(items.drop("mark"), names, bits, segments, verify)
    of = items.select("mark", "node").join(roots, "node").select("mark", "root")
    least = rows.groupBy("mark").agg(F.min("doc_id").alias("low")).join(of, "mark")
    named = least.groupBy("root").agg(F.min("low").alias("component_id")).join(least.select("root", "mark"), "root")
    return rows.join(named.select("mark", "component_id"), "mark").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their component of ``similar`` documents.

    Rows of one id are one document. Rows without an id stay only where their component has no id at all.
    """
    found = similar(docs, id_col=id_col, text_col=text_col, **how)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[id_col]), "left_anti")

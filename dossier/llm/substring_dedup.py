"""Substring dedup: documents factored against the whole corpus, long factors become duplicate spans.

Relative Lempel-Ziv parsing writes a text as factors that occur in a reference. Here the reference is
all other text, cut at content-defined anchors (the least eight-word digest of every window) into overlapping
phrases and indexed by anchor in hash-partitioned blocks, so that a phrase only meets the block that
can hold its equal. A phrase found again as a whole continues a factor; where only part of it
is found, at the ends of a factor, its windows are looked up one by one. Each document is then
parsed from left to right into maximal factors of found windows.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from dossier.session import cut

WINDOW, ANCHOR = 35, 8
_SPREAD = WINDOW - ANCHOR + 1  # anchors of one window
_C = np.uint64(0x9E3779B97F4A7C15)
_C_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KNOWN = 1 << 18  # remembered word digests per task
PHRASES = "doc_id long, digest int, anchor long, phrase long, start int, size int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Digests(dict):
    """Word to digest; a bounded number of words, the early and so the frequent ones, is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = value
        return value


class Parser:
    """Digests of words, anchors and word ranges of one text after the other."""

    def __init__(self) -> None:
        self.known = _Digests()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            factors = np.full(size, _C)
            factors[0] = 1
            self.up = np.cumprod(factors)
            factors[1:] = _C_INVERSE
            self.down = np.cumprod(factors)

    def open(self, words: list[bytes]) -> None:
        n = len(words)
        self._powers(n + 1)
        self.words = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * self.up[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Digests of the word sequences of the ranges, alike wherever they stand."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def windows(self, start: int, size: int) -> np.ndarray:
        starts = np.arange(start, start + size)
        return _mixed(self.ranges(starts, starts + WINDOW))

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, phrase digest, first window and number of windows of each phrase; every window is in just one."""
        n = len(self.words)
        if n < WINDOW:
            empty = np.zeros(0, np.uint64)
            return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(n - ANCHOR + 1)
        grams = _mixed(self.ranges(starts, starts + ANCHOR))
        owner = np.arange(n - WINDOW + 1) + sliding_window_view(grams, _SPREAD).argmin(axis=1)
        first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
        last = np.concatenate((first[1:], [len(owner)]))
        size = last - first
        digest = _mixed(self.ranges(first, last + WINDOW - 1) + size.astype(np.uint64))
        return grams[owner[first]], digest, first, size


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a digest that tells rows of one id apart, and the text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("doc_id"), F.hash(text).alias("digest"),
                       text.cast("binary").alias("text"))


def _phrases(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            parts = []
            for text in batch.column(2):
                parser.open(text.as_py().split())
                parts.append(parser.phrases())
            counts = [len(p[0]) for p in parts]
            ids, digests = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), counts) for k in (0, 1))
            anchor, phrase, start, size = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.int32()), _signed(anchor), _signed(phrase),
                 pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["doc_id", "digest", "anchor", "phrase", "start", "size"])

    return texts.mapInArrow(run, PHRASES)


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed, as they travel through shuffles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.as_py()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "digest", "text"])

    return texts.mapInArrow(run, "doc_id long, digest int, text binary")


def _windows(asked: DataFrame) -> DataFrame:
    """``anchor, phrase, at, window``: the windows of asked phrases, out of the texts that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, unpack = Parser(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text, phrases in zip(batch.column(0), batch.column(1).to_pylist()):
                parser.open(unpack(text.as_py()).split())
                for p in phrases:
                    n = p["size"]
                    for column, values in zip(out, (np.full(n, p["anchor"]), np.full(n, p["phrase"]),
                                                    np.arange(n, dtype=np.int32), parser.windows(p["start"], n).view(np.int64))):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["anchor", "phrase", "at", "window"])

    return asked.select("text", "asked").mapInArrow(run, "anchor long, phrase long, at int, window long")


def factors(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of the maximal factors: from (first window, bits of found windows) of a text's phrases."""
    spans: list[tuple[int, int]] = []
    for start, bits in sorted(set(found)):
        while bits:
            skip = (bits & -bits).bit_length() - 1
            start, bits = start + skip, bits >> skip
            run = (~bits & (bits + 1)).bit_length() - 1
            end = start + run - 1 + WINDOW
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
            start, bits = start + run, bits >> run
    return spans


def _kept(rows: DataFrame) -> DataFrame:
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            counts, spans, texts = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                words = unpack(text.as_py()).split()
                own = factors((f["start"], f["bits"]) for f in found or ())
                kept, at = [], 0
                for start, end in own:
                    kept += words[at:start]
                    at = end
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in own])
                texts.append(b" ".join(kept + words[at:]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, ranges),
                                              pa.array(texts, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return rows.select("doc_id", "text", "found").mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, kept`` for every row of ``docs``.

    ``spans`` (word ranges, end exclusive) cover every window of ``WINDOW`` words whose sequence also starts
    elsewhere, in this or another row; ``kept`` joins the other words by one space. Null and empty texts
    and texts shorter than a window have no spans; a repeated row is an elsewhere of the first; rows without
    an id come back without one; other columns are not read; an empty table gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    # anchors seen more than once, and whether around them always the same phrase stands
    # (written down, here and below, so that joins read both sides from a shuffle and can split hot anchors)
    seen = cut(_phrases(texts).groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).filter("n > 1").select(
        "anchor", (F.col("low") != F.col("high")).alias("varied")))
    again = cut(_phrases(texts).join(seen, "anchor"))
    place = F.struct("doc_id", "digest", "start", "size")
    phrases = cut(again.filter("varied").groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    # one place of each phrase whose anchor has several: its windows meet those of the other phrases
    asked = phrases.select("at.doc_id", "at.digest", F.struct("anchor", "phrase", "at.start", "at.size").alias("p")).groupBy(
        "doc_id", "digest").agg(F.collect_list("p").alias("asked"))
    windows = cut(_windows(_packed(texts).join(asked, ["doc_id", "digest"])))
    shared = cut(windows.groupBy("anchor", "window").agg(F.min("phrase").alias("low"), F.max("phrase").alias("high")).filter(
        "low != high").select("anchor", "window"))
    partly = windows.join(shared, ["anchor", "window"]).groupBy("anchor", "phrase").agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    known = cut(phrases.join(partly, ["anchor", "phrase"], "left").select(
        "anchor", "phrase", F.when(F.col("n") > 1, _ones("at.size")).otherwise(F.col("bits")).alias("bits")).filter("bits != 0"))
    same = again.filter("not varied").select("doc_id", "digest", "start", _ones("size").alias("bits"))
    mixed = again.filter("varied").join(known, ["anchor", "phrase"]).select("doc_id", "digest", "start", "bits")
    found = same.unionByName(mixed).groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("start", "bits")).alias("found"))
    rows = _kept(_packed(texts).join(found, ["doc_id", "digest"], "left"))
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(-2**63)))


def _ones(size: str) -> Column:
    """As many set bits as the column says."""
    return F.expr(f"shiftleft(1L, {size}) - 1")


def removed_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

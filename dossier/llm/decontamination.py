"""Benchmark decontamination: training texts scanned against the n-grams of a benchmark.

The benchmark's distinct windows travel to the tasks in blocks of at most ``BLOCK`` windows; every
block scans all texts, so neither a task's memory nor a broadcast grows with the benchmark.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import lower_ascii

N = 10
BLOCK = 500_000
WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_TABLE = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
               for b in range(256))
_BASE = 0x9E3779B97F4A7C15
STATE = "doc_id long, text binary, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-case ASCII letters, digits and everything beyond ASCII; the rest separates."""
    return text.translate(_TABLE).split() if text else []


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, item_id``: the distinct windows of ``N`` words of each item; a shorter item is one window."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    split = items.select(F.col(id_col).alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - N + 1))
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, N), " ")))
                        .alias("gram")).distinct()


class Scanner:
    """Finds a block of windows in word lists: rolling digests of word numbers first, then the words themselves."""

    def __init__(self, grams: Iterable[tuple[str, list[str]]]):
        self.items = {tuple(g.encode().split(b" ")): i for g, i in grams}
        self.number: dict[bytes, int] = {}
        for gram in self.items:
            for word in gram:
                self.number.setdefault(word, len(self.number) + 1)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for gram in self.items:
            by_length.setdefault(len(gram), []).append(gram)
        self.digests = {k: np.sort(np.concatenate([self._rolling(self._numbers(g), k) for g in v]))
                        for k, v in by_length.items()}

    def _numbers(self, words: Iterable[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], dtype=np.uint64)

    @staticmethod
    def _rolling(numbers: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(numbers) - length + 1, dtype=np.uint64)
        for k in range(length):
            out = out * np.uint64(_BASE) + numbers[k:k + len(out)]
        return out

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where windows occur, and the items they are of."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        numbers = self._numbers(words)
        known = numbers > 0
        for length, digests in self.digests.items():
            if len(words) < length:
                continue
            seen = np.concatenate(([0], np.cumsum(known)))
            starts = np.flatnonzero(seen[length:] - seen[:-length] == length)
            if not len(starts):
                continue
            rolled = self._rolling(numbers, length)[starts]
            at = np.minimum(np.searchsorted(digests, rolled), len(digests) - 1)
            for start in starts[digests[at] == rolled].tolist():
                owner = self.items.get(tuple(words[start:start + length]))
                if owner is not None:
                    items.update(owner)
                    if found and found[-1][0] <= start <= found[-1][1]:
                        found[-1] = (found[-1][0], max(found[-1][1], start + length))
                    else:
                        found.append((start, start + length))
        return merged(found), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The distinct windows with the items they are of, a bounded number at a time."""
    grams = benchmark_windows(items).groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    blocks = max(1, -(-grams.count() // block))
    part = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    for k in range(blocks):
        yield [(r["gram"], list(r["items"])) for r in grams.filter(part == k).toLocalIterator()]


def _scan(rows: DataFrame, block: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds what one block of windows hits to the spans and items found so far."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            words = [normal_words(text) for text in batch.column(1).to_pylist()]
            for k, own in enumerate(words):
                found, owners = scanner.spans(own)
                if found:
                    spans[k] = [{"start": x, "end": y} for x, y in
                                merged([*found, *((s["start"], s["end"]) for s in spans[k])])]
                    items[k] = sorted({*items[k], *owners})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, words), pa.int64()),
                                              pa.array(spans, ranges), pa.array(items, pa.list_(pa.string()))],
                                             names=["doc_id", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(run, STATE)


def scan(docs: DataFrame, items: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items``: every occurrence of a benchmark window in every text.

    ``spans`` are word ranges (end exclusive, overlaps merged), ``items`` the ids, as text and sorted, whose
    windows occur. Null and empty texts have no words; items without words have no window; null item ids are
    left out of ``items``; repeated rows give repeated rows; an empty benchmark hits nothing. Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.lit(0).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    for part in _blocks(items, block):
        rows = _scan(rows, part)
    return rows.drop("text")


def clean_documents(docs: DataFrame, items: DataFrame, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs; null and empty texts stay."""
    for part in _blocks(items, block):
        docs = docs.filter(~_hits(docs, part)(F.col(text_col)))
    return docs


def _hits(docs: DataFrame, block: list[tuple[str, list[str]]]) -> Callable[[Column], Column]:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            yield pd.Series([bool(scanner.spans(normal_words(None if t is None else t.encode()))[0]) for t in texts],
                            dtype=bool)

    return F.pandas_udf(run, "boolean")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of its spans; what stands between kept words stays as it was."""
    places = [m.span() for m in re.finditer(WORDS, text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

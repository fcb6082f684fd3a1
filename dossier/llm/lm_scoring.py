"""Language-model scores: smoothed n-grams as a weighted backoff automaton, one traversal per text.

Counts come from the whole training part: every n-gram of every length, also those that stand once, however large the
corpus is. The model never travels whole. Texts are dealt into blocks, written once as numbers of their
words; a block asks for its own n-grams, sorted by digest and sent as differences; the counts of an n-gram meet in the
bucket of its digest, and the answer is the row of counts in the order of the question. From them the
block builds the automaton of the n-grams that its texts can follow, and every text is read once, from left to right.

Smoothing takes each shorter context as a prior of ``PRIOR`` imagined tokens: p(w | h) = (c(h w) + K p(w | h')) /
(c(h) + K), where h' is h without its first word and p(w) the base. As every token but the end has a follower, the
chances of all words after a context sum to one. An n-gram that was not seen has the chance K / (c(h) + K) p(w | h'),
so the first factor is the weight of the failure arc and does not depend on w.

N-grams are known by digests of ``BITS`` bits: among 4e9 different ones some 60 pairs are taken for one.
"""
from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from dossier.session import cut

BLOCK = 7_000_000  # bytes of text that ask together
BUCKET, BUCKETS = 16_000_000, 256  # bytes of text for each bucket of digests, and the least number of buckets
PRIOR = (150.0, 30.0)  # imagined tokens of the shorter context, for contexts of one word, of two and more
BITS = 58  # of a digest; the last tells words from longer n-grams
PIECE = 1 << 20  # bytes of a text split at a time
END = b""  # no word is empty
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes that end at white space."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def tokens(text: bytes | None) -> Iterator[bytes]:
    for piece in pieces(text or b""):
        yield from piece.lower().split()
    yield END


def held_out(doc_id: Column) -> Column:
    """The part of the corpus that is not learned from; rows without an id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def packed(values: np.ndarray) -> bytes:
    """Bytes by their rank, compressed: the high bytes of small numbers are nearly all zero."""
    return zstandard.ZstdCompressor(level=3).compress(
        np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(value: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                     ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary()), ("bytes", pa.int64())])


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (text, doc_id, held_out) as one row for each run of about ``BLOCK`` bytes of a partition.

    A row has the digests of its different words, commonest first, and all tokens by their number among these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, number = TaskContext.get().partitionId() << 24, 0, {}
        ids, held, parts = [], [], []

        def row() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            common = np.argsort(-np.bincount(whole, minlength=len(number)), kind="stable")
            rank = np.empty(len(number), np.uint32)
            rank[common] = np.arange(len(number), dtype=np.uint32)
            digests = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") >> 64 - BITS | 1 for w in number),
                                  np.uint64, len(number))
            values = (block, ids, held, [len(p) for p in parts], packed(digests[common]), packed(rank[whole]), done)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _BLOCKS.types)], schema=_BLOCKS)

        for batch in batches:
            for text, doc_id, apart in zip(*batch.columns):
                text = text.as_py()
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in tokens(text)), np.uint32))
                ids.append(doc_id.as_py())
                held.append(apart.as_py())
                done += len(text)
                if done >= BLOCK:
                    yield row()
                    block, done, number = block + 1, 0, {}
                    ids, held, parts = [], [], []
        if parts:
            yield row()

    return rows.select("text", "doc_id", "held_out").mapInArrow(
        run, "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, words binary, tokens binary, bytes long")


class Grams(NamedTuple):
    """The different n-grams of one length: place of one occurrence's end, digest, and the number of the n-gram that ends at each place."""
    at: np.ndarray
    keys: np.ndarray
    number: np.ndarray


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Digests of n-grams from those of their contexts and last words; the last bit tells them from words."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x >> np.uint64(64 - BITS) & ~np.uint64(1)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different key, in the order of the keys, and for every place the number of its key in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new].astype(np.int32), number


def grams(sizes: np.ndarray, digests: np.ndarray, numbers: np.ndarray, order: int) -> list[Grams]:
    """The n-grams of a block by length; those of a length are numbered by context and last word.

    ``number`` is -1 where no n-gram of that length ends inside its text.
    """
    starts = np.cumsum(sizes) - sizes
    at = np.empty(len(digests), np.int32)
    at[numbers] = np.arange(len(numbers), dtype=np.int32)
    found = [Grams(at, digests, numbers.astype(np.int32))]
    inside = np.ones(len(numbers), bool)
    for length in range(2, order + 1):
        before = found[-1]
        inside[starts[sizes >= length - 1] + length - 2] = False
        ends = np.flatnonzero(inside).astype(np.int32)
        at, own = _ranked(before.number[ends - 1] * np.int64(len(digests)) + numbers[ends])
        number = np.full(len(numbers), -1, np.int32)
        number[ends] = own
        at = ends[at]
        found.append(Grams(at, _mixed(before.keys[before.number[at - 1]], digests[numbers[at]]), number))
    return found


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(row["sizes"], np.int64), unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.uint32)


def _distinct(found: list[Grams]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted digests of all n-grams, and for each n-gram, lengths one after the other, its place among them."""
    keys = np.concatenate([f.keys for f in found])
    at, place = _ranked(keys)
    return keys[at], place


_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << BITS) // buckets for k in range(buckets)], np.uint64)


def _asked(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """A row for each block and bucket, a range of digests: sorted digests as differences, and counts in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for row in batch.to_pylist():
                sizes, digests, numbers = _read(row)
                learned = np.repeat(~np.array(row["held_out"], bool), sizes)
                found = grams(sizes, digests, numbers, order)
                keys, place = _distinct(found)
                own = np.concatenate([np.bincount(f.number[learned & (f.number >= 0)], minlength=len(f.keys)) for f in found])
                counts = np.bincount(place, weights=own, minlength=len(keys)).astype(np.uint32)
                cuts = [*np.searchsorted(keys, edges), len(keys)]
                rows = [(k, row["block"], packed(np.diff(keys[a:b], prepend=edges[k])), packed(counts[a:b]))
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ASKED.types)], schema=_ASKED)

    return blocks.select("block", "held_out", "sizes", "words", "tokens").mapInArrow(
        run, "bucket int, block long, grams binary, counts binary")


_COUNTED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("words", pa.int64()), ("kinds", pa.int64())])


def _counted(asked: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the counts in all training texts, as asked; and, in a row without a block, the words
    of the bucket and its different words."""
    def run(table: pa.Table) -> pa.Table:
        here = table["bucket"][0].as_py()
        parts = [np.cumsum(unpacked(g.as_py(), np.uint64), dtype=np.uint64) + _edges(buckets)[here] for g in table["grams"]]
        asked = np.concatenate(parts)
        at, place = _ranked(asked)
        keys = asked[at]
        own = np.concatenate([unpacked(c.as_py(), np.uint32) for c in table["counts"]])
        totals = np.bincount(place, weights=own, minlength=len(keys)).astype(np.int64)
        word = (keys & np.uint64(1)).astype(bool) & (totals > 0)
        rows = [(here, None, b"", int(totals[word].sum()), int(word.sum()))]
        ends = np.cumsum([len(p) for p in parts])
        for block, end, part in zip(table["block"].to_pylist(), ends, parts):
            rows.append((here, block, packed(totals[place[end - len(part):end]]), 0, 0))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTED.types)], schema=_COUNTED)

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, counts binary, words long, kinds long")


def _items(parts: list[np.ndarray]) -> array:
    """The values in a row of machine numbers, read one by one faster than those of numpy."""
    values = np.concatenate(parts) if parts else np.zeros(0)
    whole = array("d" if values.dtype.kind == "f" else "i")
    whole.frombytes(values.astype(np.float64 if values.dtype.kind == "f" else np.int32).tobytes())
    return whole


class Automaton:
    """States are the contexts seen in training, the root is the empty one; arcs are the n-grams seen.

    ``found`` are the n-grams of the texts to be read and ``counts`` how often each stands in training, length by length;
    ``n`` and ``v`` are the words of training and the different ones. Arcs of a state lie together, sorted by word.
    """

    def __init__(self, found: list[Grams], counts: list[np.ndarray], n: int, v: int, prior: tuple[float, ...] = PRIOR):
        numbers = found[0].number
        self.known, self.base = counts[0] > 0, np.log10((counts[0] + 1) / (n + v + 1))
        first = np.cumsum([1, *(len(c) for c in counts)])  # number of the first state of each length
        self.root, self.start = self.base.tolist(), np.where(self.known & (len(found) > 1), first[0] + np.arange(len(counts[0])), 0).tolist()
        chance, offsets, words, weights, targets = 10 ** self.base, [np.zeros(2, np.int64)], [], [], []
        fail, back, arcs = [np.zeros(1)], [np.zeros(1, np.int64)], 0
        for k in range(1, len(found)):
            shorter, longer, c, mass = found[k - 1], found[k], counts[k], prior[min(k, len(prior)) - 1]
            context, suffix = shorter.number[longer.at - 1], shorter.number[longer.at]
            chance = (c + mass * chance[suffix]) / (counts[k - 1][context] + mass)
            seen = np.flatnonzero(c > 0)
            words.append(numbers[longer.at[seen]])
            weights.append(np.log10(chance[seen]))
            targets.append(first[k] + seen if k < len(found) - 1 else first[k - 1] + suffix[seen])
            offsets.append(arcs + np.searchsorted(context[seen], np.arange(1, len(counts[k - 1]) + 1)))
            arcs += len(seen)
            fail.append(np.log10(mass / (counts[k - 1] + mass)))
            back.append(first[k - 2] + found[k - 2].number[shorter.at] if k > 1 else np.zeros(len(counts[0]), np.int64))
        self.offsets, self.fail, self.back = (_items(x) for x in (offsets, fail, back))
        self.words, self.weights, self.targets = (_items(x) for x in (words, weights, targets))

    def read(self, words: Iterable[int]) -> float:
        """Log10 probability of a text: the state is carried from word to word, a missing arc goes down the failure arc."""
        offsets, own, weights, targets, fail, back = self.offsets, self.words, self.weights, self.targets, self.fail, self.back
        root, start, state, score = self.root, self.start, 0, 0.0
        for word in words:
            while state:
                end = offsets[state + 1]
                arc = bisect_left(own, word, offsets[state], end)
                if arc < end and own[arc] == word:
                    score += weights[arc]
                    state = targets[arc]
                    break
                score += fail[state]
                state = back[state]
            else:
                score += root[word]
                state = start[word]
        return score


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(blocks: DataFrame, counted: DataFrame, n: int, v: int, order: int) -> DataFrame:
    """Each block builds the automaton of its own n-grams from the answers and reads its texts with it."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        sizes, digests, numbers = _read(row)
        found = grams(sizes, digests, numbers, order)
        _, place = _distinct(found)
        totals = np.concatenate([unpacked(c.as_py(), np.int64) for c in answers.sort_by("bucket")["counts"]])[place]
        counts = np.split(totals, np.cumsum([len(f.keys) for f in found])[:-1])
        model = Automaton(found, counts, n, v)
        starts = np.cumsum(sizes) - sizes
        scores = [model.read(numbers[a:a + size].tolist()) for a, size in zip(starts, sizes)]
        columns = (row["doc_ids"], row["held_out"], sizes, np.add.reduceat(model.known[numbers].astype(np.int64), starts),
                   np.add.reduceat(model.base[numbers], starts), scores)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORED.types)], schema=_SCORED)

    own = counted.filter(F.col("block").isNotNull()).select("block", "bucket", "counts")
    return blocks.select("block", "doc_ids", "held_out", "sizes", "words", "tokens").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    A text's tokens are its words and one end. Null and empty texts are an end alone; repeated rows count as
    often as they stand and come back as often; rows without an id are learned from; without any training
    row all words are unseen. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    blocks = cut(_blocked(rows))
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, math.ceil(size / BUCKET))
    counted = cut(_counted(_asked(blocks, order, buckets), buckets))
    n, v = counted.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    done = _scored(blocks, counted, n, v, order)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

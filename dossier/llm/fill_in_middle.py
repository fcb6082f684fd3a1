"""Fill-in-middle texts over seekable compressed frames.

A text is stored as zstandard frames of about ``FRAME`` bytes that decompress by themselves, each with the number of
units (words with the white space before them) that have ended up to its end. A cut after a number of units needs
one look into these counts and one decompressed frame. The transformed text is again a list of frames: whole frames
between the cuts go over as they are, only pieces of cut frames and markers are compressed anew. Digests and the way back
stream the frames in order, one decompressed at a time.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

FRAME, LEVEL = 1 << 16, 3
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
SEED, RATE, SPM_RATE = 42, 50, 80

_FRAME_TYPE = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])
STORED = "doc_id long, marked boolean, frames array<struct<units: long, chars: long, data: binary>>"
FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"


def _chars(data: bytes) -> int:
    """Code points of a piece of UTF-8."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _ends(data: bytes, follower: int) -> np.ndarray:
    """Places where a unit ends, ``follower`` being the byte after ``data``, or -1 at the end of the text."""
    raw = np.frombuffer(data, np.uint8)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    after = np.empty_like(word)
    after[:-1] = word[1:]
    after[-1] = False if follower < 0 else not (follower == 32 or 9 <= follower <= 13)
    ends = np.flatnonzero(word & ~after) + 1
    return ends if follower >= 0 or word[-1] else np.append(ends, len(data))


def frames_of(text: bytes, compress: Callable[[bytes], bytes], frame: int = FRAME) -> Iterator[tuple[int, int, bytes]]:
    """The frames of a text with units and code points up to the end of each; they begin at whole characters."""
    start = units = chars = 0
    while start < len(text):
        end = min(start + frame, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        data = text[start:end]
        units += len(_ends(data, text[end] if end < len(text) else -1))
        chars += _chars(data)
        yield units, chars, compress(data)
        start = end


def stored(docs: DataFrame, frame: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The seekable form of every text: ``doc_id``, ``marked`` (a marker stands in the text) and ``frames``.

    Null and empty texts have no frames; repeated rows and null ids give rows of their own; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            offsets, marked, parts = [0], [], []
            for value in batch.column(1):
                text = value.as_py() or b""
                marked.append(any(m in text for m in MARKS.values()))
                parts.extend(frames_of(text, compress, frame))
                offsets.append(len(parts))
            fields = [pa.array([p[k] for p in parts], t.type) for k, t in enumerate(_FRAME_TYPE)]
            frames = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_FRAME_TYPE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked), frames], names=["doc_id", "marked", "frames"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, STORED)


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide about a document; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k:k + 8], 16) for k in (0, 8, 16, 24)]


class Selection:
    """Spans of a stored text between unit counts; decompresses the frames that hold a cut, and no others."""

    def __init__(self, units: Sequence[int], chars: Sequence[int], frames: Sequence[bytes]):
        self.units, self.chars, self.frames = units, chars, frames
        self._opened: tuple[int, bytes] = (-1, b"")

    def _open(self, frame: int) -> bytes:
        if self._opened[0] != frame:
            self._opened = frame, zstandard.ZstdDecompressor().decompress(self.frames[frame])
        return self._opened[1]

    def cut(self, count: int) -> tuple[int, int, int]:
        """Frame, place in it and code points before the place where the first ``count`` units have ended."""
        if count == 0:
            return 0, 0, 0
        frame = bisect_left(self.units, count)
        data, nth = self._open(frame), count - (self.units[frame - 1] if frame else 0)
        ends = _ends(data, 32)  # a unit that ends with the frame is the last of it either way
        place = int(ends[nth - 1]) if nth <= len(ends) else len(data)
        return frame, place, (self.chars[frame - 1] if frame else 0) + _chars(data[:place])

    def span(self, low: tuple[int, int, int], high: tuple[int, int, int], mark: bytes, compress: Callable[[bytes], bytes]) -> Iterator[bytes]:
        """Frames of a marker and the text between two cuts; the ones between the cut frames go over as they are."""
        (first, start, _), (last, stop, _) = low, high
        if first == last:
            yield compress(mark + (self._open(first)[start:stop] if stop > start else b""))
            return
        if start:
            yield compress(mark + self._open(first)[start:])
        else:
            yield compress(mark)
            yield self.frames[first]
        yield from self.frames[first + 1:last]
        if stop:
            yield compress(self._open(last)[:stop])

    def end(self) -> tuple[int, int, int]:
        """The end of the text as a cut."""
        return len(self.frames), 0, self.chars[-1]


def filled(store: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The transformed texts of ``stored``: units, form, code points of prefix and middle, and ``output`` as frames.

    Empty texts, texts that hold a marker and all but ``rate`` of a hundred documents stay plain; of the rest
    ``spm_rate`` of a hundred begin with the suffix. A rerun gives the same rows; an empty table gives none.
    """
    def one(doc_id: int | None, marked: bool, frames: list[dict], compress: Callable[[bytes], bytes]) -> tuple:
        n = frames[-1]["units"] if frames else 0
        h1, h2, h3, h4 = numbers(doc_id, seed)
        data = [f["data"] for f in frames]
        if not frames or marked or h3 % 100 >= rate:
            return n, "plain", None, None, data
        form = "spm" if h4 % 100 < spm_rate else "psm"
        text = Selection([f["units"] for f in frames], [f["chars"] for f in frames], data)
        low, high = (text.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        spans = {"P": ((0, 0, 0), low), "M": (low, high), "S": (high, text.end())}
        output = [x for k in ORDERS[form] for x in text.span(*spans[k], MARKS[k], compress)]
        return n, form, low[2], high[2] - low[2], output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = [one(i.as_py(), m.as_py(), f.as_py(), compress) for i, m, f in zip(*batch.columns)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return store.select("doc_id", "marked", "frames").mapInArrow(run, FILLED)


def _parts(frames: Sequence[bytes], low: int, high: int) -> Iterator[bytes]:
    """The bytes between two places of a list of frames; frames outside are skipped by their size alone."""
    at, reader = 0, zstandard.ZstdDecompressor()
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        if at < high and at + size > low:
            yield reader.decompress(frame)[max(0, low - at):high - at]
        at += size


def read_back(frames: Sequence[bytes], form: str, seen: Callable[[bytes], None] = lambda data: None) -> Iterator[bytes]:
    """The original text from transformed frames and form, piece by piece; ``seen`` gets the frames as they stand.

    The first occurrence of each marker in the order of the form is the real one: no marker stands in the text, and none
    can begin in a part and end in the marker after it.
    """
    reader, at, carry, places = zstandard.ZstdDecompressor(), 0, b"", []
    wanted = [MARKS[k] for k in ORDERS.get(form, "")]
    for frame in frames:
        data = reader.decompress(frame)
        seen(data)
        window, base, start = carry + data, at - len(carry), 0
        while len(places) < len(wanted) and (found := window.find(wanted[len(places)], start)) >= 0:
            places.append(base + found)
            start = found + 3
        carry = window[max(start, len(window) - 2):]
        at += len(data)
    if not wanted:
        yield from _parts(frames, 0, at)
        return
    spans = {k: (low + 3, high) for k, low, high in zip(ORDERS[form], places, [*places[1:], at])}
    for k in "PMS":
        yield from _parts(frames, *spans[k])


def digested(rows: DataFrame) -> DataFrame:
    """Adds SHA-256 of the output and of the text read back from output and form, without ``output``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, restored = [], []
            for form, frames in zip(batch.column("form"), batch.column("output")):
                whole, text = hashlib.sha256(), hashlib.sha256()
                for piece in read_back(frames.as_py(), form.as_py(), whole.update):
                    text.update(piece)
                shown.append(whole.hexdigest())
                restored.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shown, pa.string()), pa.array(restored, pa.string())],
                                             names=[*batch.schema.names[:-1], "output_sha256", "restored_sha256"])

    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
    return rows.mapInArrow(run, columns + ", output_sha256 string, restored_sha256 string")


def as_text(rows: DataFrame) -> DataFrame:
    """The rows of ``filled`` with the transformed text as a string in ``output``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader = zstandard.ZstdDecompressor()
            texts = [b"".join(map(reader.decompress, frames.as_py())).decode() for frames in batch.column("output")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return rows.mapInArrow(run, FILLED.replace("array<binary>", "string"))

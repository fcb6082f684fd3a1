"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a text, its characters at first, form a linked list. A heap holds the adjacent pairs that are a piece
of the vocabulary; the one of lowest rank is popped, its two symbols become one, and the pairs with the two new
neighbours go onto the heap. Each merge takes one symbol away, so the count is the first symbols less the merges
(a character outside the vocabulary stands for its bytes), and no identifier is ever looked up.

A merge can cross two characters only if some piece holds them side by side. The text is therefore merged run by run
between such places, which gives the same merges and keeps the list short; short runs are remembered by each worker.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"  # stands for a space in the pieces
_KEPT_RUNS, _KEPT_CHARS = 1 << 19, 48  # what a worker remembers: speed only, no result depends on it


class Merger:
    """The merge ranks of a vocabulary with byte fallback, as costs by piece: the least cost merges first."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.known = frozenset(p for p in costs if len(p) == 1)
        longer = [p for p in costs if len(p) > 1]
        self.pairs = {p[k:k + 2] for p in longer for k in range(len(p) - 1)}
        inside = set("".join(longer))
        alone = "".join(map(re.escape, (c for c in map(chr, range(128)) if c not in inside)))
        if any(p[1] == BLANK != p[0] for p in self.pairs):
            self.pattern = re.compile(f"[^{alone}]+|[{alone}]" if alone else ".+", re.S)
        else:
            self.pattern = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else ""))
        self.remembered = lru_cache(_KEPT_RUNS)(self.of_run)

    def of_run(self, run: str) -> int:
        """Tokens of a run: the heap and the linked list."""
        costs, end = self.costs, len(run)
        length, before, after = [1] * end, list(range(-1, end - 1)), list(range(1, end + 1))
        heap = [(cost, k, k + 1, 2) for k in range(end - 1) if (cost := costs.get(run[k:k + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, a, b, both = heappop(heap)
            if not length[a] or not length[b] or length[a] + length[b] != both:
                continue  # one of the two has been merged since
            merges += 1
            length[a], length[b] = both, 0
            follower, leader = after[b], before[a]
            after[a] = follower
            if follower < end:
                before[follower] = a
                whole = both + length[follower]
                if (cost := costs.get(run[a:a + whole])) is not None:
                    heappush(heap, (cost, a, follower, whole))
            if leader >= 0:
                whole = a - leader + both
                if (cost := costs.get(run[leader:a + both])) is not None:
                    heappush(heap, (cost, leader, a, whole))
        if self.known.issuperset(run):
            return end - merges
        return end - merges + sum(len(c.encode()) - 1 for k, c in enumerate(run) if length[k] == 1 and c not in costs)

    def of_part(self, part: str) -> int:
        """Tokens of a part of a text: its runs, cut where no piece holds both characters."""
        pairs, count, start = self.pairs, 0, 0
        for k in range(1, len(part)):
            if part[k - 1:k + 1] not in pairs:
                count += self.of_run(part[start:k])
                start = k
        return count + self.of_run(part[start:])

    def of_text(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        count, remembered, part_of = 0, self.remembered, self.of_part
        for found in self.pattern.finditer(BLANK + text.replace(" ", BLANK)):
            part = found[0]
            count += remembered(part) if len(part) <= _KEPT_CHARS else part_of(part)
        return count


@cache
def merger(path: str | None = None) -> Merger:
    """The merges of a model file (of ``MODEL`` where no path is given), read once by each worker.

    The model must leave the characters as they are, put one blank in front and fall back to bytes; one with
    unused pieces or pieces of the user's is refused or not known here.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    ids = range(model.piece_size())
    if model.normalize(" Aéﬁ  b ") != f"{BLANK}{BLANK}Aéﬁ{BLANK}{BLANK}b{BLANK}":
        raise ValueError("the model changes characters or blanks before it merges")
    if any(map(model.is_unused, ids)) or sum(map(model.is_byte, ids)) != 256:
        raise ValueError("the model has unused pieces or no pieces for bytes")
    special = [i for i in ids if model.is_unknown(i) or model.is_control(i) or model.is_byte(i)]
    return Merger({model.id_to_piece(i): -model.get_score(i) for i in sorted(set(ids) - set(special))})


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, counted over the whole text.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids give rows of their own; strings of
    special tokens are ordinary text; other columns are not read; an empty table gives no rows. ``path`` is a model
    file that every worker can open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = merger(path).of_text
        for batch in batches:
            counts = [of_text(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

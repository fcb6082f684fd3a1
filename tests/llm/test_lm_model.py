"""The scores against a plain recursive model over whole n-gram counts."""
from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from dossier.llm import lm_scoring

DOCS = "doc_id long, text string"


class Plain:
    """p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K), the base without a context; contexts that were not seen are skipped."""

    def __init__(self, texts, order=3):
        self.counts, self.order = Counter(), order
        for words in texts:
            for length in range(1, order + 1):
                self.counts.update(tuple(words[k:k + length]) for k in range(len(words) - length + 1))
        self.v = sum(len(g) == 1 for g in self.counts)
        self.n = sum(c for g, c in self.counts.items() if len(g) == 1)

    def chance(self, history, word):
        if not history:
            return (self.counts[word,] + 1) / (self.n + self.v + 1)
        mass = lm_scoring.PRIOR[min(len(history), len(lm_scoring.PRIOR)) - 1]
        return (self.counts[*history, word] + mass * self.chance(history[1:], word)) / (self.counts[history] + mass)

    def score(self, words):
        return sum(math.log10(self.chance(tuple(words[max(0, k - self.order + 1):k]), w)) for k, w in enumerate(words))


def train(rows):
    return [list(lm_scoring.tokens((t or "").encode())) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]


def check(spark, rows, order=3):
    plain = Plain(train(rows), order)
    want = []
    for i, t in rows:
        w = list(lm_scoring.tokens((t or "").encode()))
        want.append((i if i is not None else -1, len(w), sum(plain.counts[x,] > 0 for x in w),
                     sum(math.log10(plain.chance((), x)) for x in w), plain.score(w)))
    got = lm_scoring.scores(spark.createDataFrame(rows, DOCS).repartition(3), order).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {plain.n}
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    for r, x in zip(got, sorted(want)):
        assert r[:3] == x[:3]
        assert r[3:] == pytest.approx(x[3:], abs=1e-8)


def test_every_ngram_of_all_blocks_is_in_the_model(spark, monkeypatch):
    """60,000 tokens in many blocks; some words stand once or twice; an unseen word inside a text; a repeated row."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)
    rng = random.Random(11)
    rows = [(k, " ".join("w%d" % int(rng.paretovariate(0.6)) for _ in range(300))) for k in range(200)]
    rows += [(k, "rare phrase of few words w1 w2") for k in range(200, 204)] + [(900, None), (None, "rare phrase"), (901, "zz w1 zz"), (901, "zz w1 zz")]
    check(spark, rows)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders_and_texts_in_pieces(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "PIECE", 7)
    rows = [(k, "A b  c\ta b\x0bd a b c " * (k % 4) + "eé  x" + "y" * k) for k in range(30)] + [(31, ""), (32, "  \n ")]
    check(spark, rows, order)


def test_all_texts_held_out(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:5]
    check(spark, [(k, "a b c") for k in held])


def test_chances_of_every_seen_context_sum_to_one():
    texts = train([(None, "a b c a b c a b d a b c b c"), (None, "b c a"), (None, "")])
    plain = Plain(texts)
    words = [g[0] for g in plain.counts if len(g) == 1]
    for history in {g[:-1] for g in plain.counts}:
        assert sum(plain.chance(history, w) for w in [*words, b"unseen"]) == pytest.approx(1)


def test_state_is_carried_along_failure_arcs():
    """One text read as it was learned, and one whose words never follow each other in training."""
    learned, odd = [0, 1, 2, 0, 1, 3, 4], [3, 2, 1, 0, 4]
    sizes, numbers = np.array([7, 5]), np.array(learned + odd, np.uint32)
    found = lm_scoring.grams(sizes, np.arange(1, 11, 2).astype(np.uint64) << np.uint64(40) | np.uint64(1), numbers, 3)
    first = np.arange(12) < 7
    counts = [np.bincount(f.number[first & (f.number >= 0)], minlength=len(f.keys)) for f in found]
    model = lm_scoring.Automaton(found, counts, 7, 5)
    plain = Plain([learned])
    for text in (learned, odd, [], [2]):
        assert model.read(text) == pytest.approx(plain.score(text), abs=1e-9)

"""Fill-in-middle, filter audit and token counts: brute force, round trips and odd rows."""
from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dossier.llm import bpe_counts, fill_in_middle as fim, filter_audit

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n long, output string, units int, part string, fails int, digest string, _first long, _m int"
PLAIN = zstandard.ZstdCompressor(level=1).compress


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "x", 8, "y", 7, "z", 6, 5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows, copies, markers, texts of several MB, rare characters."""
    rng = random.Random(9)
    vocabulary = ["w%d" % k for k in range(400)] + ["Ärger", "été", "😀", "中文字", "UPPER", "a#b", "▁x", "<0x0A>", "</s>"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 400))), "s%d" % (k % 3)) for k in range(60)]
    rows += [(k, rows[k % 5][1], "s%d" % (k % 3)) for k in range(100, 130)]
    rows += [(200, "", "s0"), (201, None, None), (202, " \n\t ", ""), (None, rows[0][1], "s1"), (None, None, None), (5, rows[5][1], "s2"),
             (5, rows[5][1], "s2"), (-7, rows[6][1], "s1"), (203, "a <P> b", "s1"), (204, "<S<S>", "s1"), (205, "x\x0bword\x1c　y  ", "s2"),
             (206, "mega Ä😀 word\n" * 200_000, "s0"), (207, "ab" * 200_000, "s0"), (208, "<P < S> <M", "s0")]
    return rows


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digits = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k:k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, output = "plain", text
    elif h4 % 100 < 80:
        form, output = "spm", "<S>" + s + "<P>" + p + "<M>" + m
    else:
        form, output = "psm", "<P>" + p + "<S>" + s + "<M>" + m
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *sizes, output)


@pytest.mark.parametrize("frame", [fim.FRAME, 7])
def test_fill_in_middle_equals_brute_force(spark, odd, frame):
    rows = [r for r in odd if frame > 7 or r[1] is None or len(r[1]) < 10_000]
    store = fim.stored(docs_of(spark, rows), frame)
    want = [brute_fim(i, t) for i, t, _ in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.digested(fim.filled(store)).collect()), key=str)
    assert got == sorted(((*w[:5], digest(w[5]), digest(t or "")) for w, (_, t, _) in zip(want, rows)), key=str)
    texts = fim.as_text(fim.filled(store)).select("doc_id", "output").collect()
    assert sorted(map(str, texts)) == sorted(f"Row(doc_id={w[0]}, output={w[5]!r})" for w in want)
    assert fim.digested(fim.filled(fim.stored(docs_of(spark, [])))).count() == 0


def test_only_cut_frames_are_decompressed(monkeypatch):
    text = ("some words \n of a long text " * 20_000).encode()
    parts = list(fim.frames_of(text, PLAIN, 1000))
    whole = fim.Selection(*zip(*parts))
    units = UNIT.findall(text.decode())
    assert parts[-1][0] == len(units) and len(parts) > 400
    for count in (0, 1, 37, len(units) // 2, len(units) - 1, len(units)):
        frame, place, chars = whole.cut(count)
        assert chars == sum(map(len, units[:count])) and (count == 0 or parts[frame - 1][0] < count or frame == 0)
    opened = []
    monkeypatch.setattr(fim.Selection, "_open", lambda self, k: opened.append(k) or zstandard.ZstdDecompressor().decompress(self.frames[k]))
    low, high = whole.cut(1000), whole.cut(50_000)
    out = list(whole.span(low, high, b"<M>", PLAIN))
    assert set(opened) == {low[0], high[0]} and sum(f in set(whole.frames) for f in out) > 100


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM \n\tÄ😀\x1c", max_size=40), st.integers(1, 9), st.integers(0, 50), st.integers(0, 50), st.sampled_from(["psm", "spm"]))
def test_any_cut_reads_back(text, frame, a, b, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")) or not text:
        return
    units = UNIT.findall(text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    whole = fim.Selection(*zip(*fim.frames_of(text.encode(), PLAIN, frame)))
    cuts = whole.cut(low), whole.cut(high)
    spans = {"P": ((0, 0, 0), cuts[0]), "M": cuts, "S": (cuts[1], whole.end())}
    frames = [x for k in fim.ORDERS[form] for x in whole.span(*spans[k], fim.MARKS[k], PLAIN)]
    own = {"P": "".join(units[:low]), "M": "".join(units[low:high]), "S": "".join(units[high:])}
    shown = []
    assert b"".join(fim.read_back(frames, form, shown.append)).decode() == text
    assert b"".join(shown).decode() == "".join(f"<{k}>{own[k]}" for k in fim.ORDERS[form])


def brute_fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((i, s or "", "".join(x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
            i is not None and i > first[t])) if bad)))
    return out


def test_audit_equals_walking_every_order(spark, odd):
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 130, 2)] + [(5, 1, True), (5, 0, False), (None, 1, True)]
    table = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q}, {i for i, _, t in labels if t}
    fails = brute_fails(odd)
    made = filter_audit.failures(docs_of(spark, odd)).collect()
    assert sorted(str((r[0], r[1], "".join(x for k, x in enumerate("ABCDE") if r[2] >> k & 1))) for r in made) == sorted(map(str, fails))
    assert {x for _, _, f in fails for x in f} == set("ABCDE")
    want, shares = {}, {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                late = sum(1 for _, f in own if x in f) - len(gone)
                left = [(i, f) for i, f in left if x not in f]
                want[part, order, k + 1] = [len(left), len(gone), late, sum(1 for _, f in own if f == x),
                                            sum(1 for i, _ in gone if i is not None and i in good), sum(1 for i, _ in gone if i is not None and i in toxic)]
                shares[part, x] = shares.get((part, x), 0) + len(gone)
    got = filter_audit.interactions(docs_of(spark, odd), table).collect()
    assert len(got) == len(want) == 600 * len({p for _, p, _ in fails})
    for r in got:
        assert list(r)[3:] == want[r[0], r[1], r[2]] + [shares[r[0], r[1][r[2] - 1]]]
    assert filter_audit.interactions(docs_of(spark, []), table).count() == 0
    assert filter_audit.interactions(docs_of(spark, odd), table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(bpe_counts.MODEL))


def test_counts_equal_the_library(spark, odd, piece):
    rows = odd
    got = sorted((tuple(r) for r in bpe_counts.counted(docs_of(spark, rows), limit=100).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(piece.encode(t or "")), n > 100) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert bpe_counts.counted(docs_of(spark, [])).count() == 0


def test_counts_on_real_documents(spark, piece):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in bpe_counts.counted(docs).collect()}
    assert got == {r["doc_id"]: len(piece.encode(r["text"] or "")) for r in docs.collect()}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst ▁<>s0A\n😀中", max_size=80)))
def test_counts_of_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(bpe_counts.MODEL))
    assert bpe_counts.merger().of_text(text) == len(own.encode(text))


def test_heap_pops_the_least_cost_first():
    model = bpe_counts.Merger({c: 9.0 for c in "abc▁"} | {"ab": 2.0, "bc": 1.0, "abc": 3.0, "▁a": 4.0, "aa": 5.0})
    assert model.of_text("abc") == 2  # ▁, abc: bc merges before ab
    assert model.of_text("aaa") == 2  # ▁a first, then aa
    assert model.of_text("xab") == 3 and model.of_text("é") == 3  # a character outside counts its bytes
    assert model.of_run("a" * 50_001) == 25_001

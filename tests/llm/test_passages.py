"""Line dedup of short passages, against brute force."""
from __future__ import annotations

import random

from dossier.llm import line_dedup

DOCS = "doc_id long, text string, _before int"


def brute(rows):
    """Text by row number: pairs of neighbouring full lines stay at their least place only."""
    places, first, out = [], {}, []
    for i, t in sorted(rows):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        for a, b in zip(full, full[1:]):
            unit = "\n".join(lines[a:b + 1])
            first.setdefault(unit, (i, a))
            places.append((i, a, b, unit))
    for i, t in rows:
        gone = {p for d, a, b, u in places if d == i and first[u] != (i, a) for p in range(a, b + 1)}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out)


def test_short_passages_in_other_documents_go(spark):
    rng = random.Random(7)
    own = lambda d, n: ["own line %d of %d" % (k, d) for k in range(n)]
    shared = {n: ["shared %d of %d" % (k, n) for k in range(n)] for n in (2, 3, 4, 5)}
    rows = []
    for d in range(40):
        lines = own(d, rng.randint(1, 9))
        at = rng.randint(0, len(lines))
        rows.append((d, "\n".join(lines[:at] + shared[2 + d % 4] + lines[at:])))
    rows += [(50, "a\n\nb\n\nc"), (51, "x\na\n\nb\ny"), (52, "a\nb"), (53, "one\n\n"), (54, "one\n\nz"), (55, "r\nr\nr\nr"),
             (56, ""), (57, "\n\n"), (58, "\n\n\n")]
    made = [(i, t, 1) for i, t in rows] + [(None, None, 1)]
    got = line_dedup.without_passages(spark.createDataFrame(made, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == brute(rows)
    assert [r["text"] for r in got if r["doc_id"] is None] == [None]
    left = {r["doc_id"]: r for r in got}
    for d in range(4, 40):
        assert "shared" not in left[d]["text"]
        assert left[d]["_before"]["lines"] - left[d]["_after"]["lines"] == 2 + d % 4
    lines = {x for _, t in rows for x in t.split("\n")}
    assert lines == {x for r in got for x in (r["text"] or "").split("\n")}  # no line is lost everywhere
    assert line_dedup.without_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stage_drops_a_short_passage(spark):
    import corpus_pipeline
    rows = [(1, "u\np1\np2\nv", "en", "s", 9), (2, "w\np1\np2\nx", "en", "s", 9), (3, "p1\np2", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: ("u\np1\np2\nv", 9), 2: ("w\nx", 3)}

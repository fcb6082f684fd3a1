"""Columns of the caller named like an operator's own keep their values."""
from __future__ import annotations

from pyspark.sql import functions as F

from dossier.llm import line_dedup, mixing

NAMES = ("_id", "_digest", "_source", "_n", "_id2", "_digest2", "_gone", "_done", "_text", "_n2", "_copies", "_before", "copies", "_row")


def _docs(spark, **names):
    rows = [(k, "one line here\nand another\nown %d" % k, "s%d" % (k % 2)) for k in range(8)] + [(None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return plain, plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in NAMES})


def test_values_survive(spark):
    plain, docs = _docs(spark)
    for run, added in ((line_dedup.without_repeats, {"_before", "_after"}), (line_dedup.without_passages, {"_before", "_after"}),
                       (mixing.mixture, {"copy"})):
        got = run(docs)
        kept = [c for c in NAMES if c not in added]
        assert set(got.columns) == set(docs.columns) | added
        rows = got.collect()
        for r in rows:
            mark = "none" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[c] == c + mark for c in kept)
        own = run(plain).collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in own)


def test_key_columns_may_begin_with_an_underscore(spark):
    plain, _ = _docs(spark)
    got = line_dedup.without_repeats(plain.withColumnsRenamed({"doc_id": "_id", "text": "_text"}), id_col="_id", text_col="_text")
    assert set(got.columns) == {"_id", "_text", "source", "_before", "_after"} and got.count() == 9

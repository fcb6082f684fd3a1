"""Folding of all code points, DOCX of any size, revoked sessions."""
from __future__ import annotations

import io
import unicodedata
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dossier.functions.text import fold_ascii
from dossier.sources import files
from dossier.streaming import jobs


def test_folding_equals_nfkd_on_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(map(chr, codes[k:k + 997])),) for k in range(0, len(codes), 997)]
    for r in spark.createDataFrame(rows, "s string").select("s", fold_ascii("s").alias("t")).collect():
        assert r["t"] == unicodedata.normalize("NFKD", r["s"]).encode("ascii", "ignore").decode()


def _docx(body: str, part: str = "word/document.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(part, f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_gate_and_whole_texts(spark):
    long = "<w:p><w:r><w:t>some words</w:t></w:r><w:r><w:t/></w:r></w:p>" * 100_000
    rows = [("/a/ok.docx", _docx("<w:p><w:r><w:t>one</w:t><w:t>two</w:t></w:r></w:p>")), ("/a/long.docx", _docx(long)),
            ("/a/cut.docx", _docx("x")[:-30]), ("/a/part.docx", _docx("x", "other.xml")), ("/a/none.docx", _docx("<w:p/>")),
            ("/a/no.docx", b"plain"), ("/a/empty.docx", b""), ("/a/null.docx", None), ("/a/t.txt", b"text")]
    given = spark.createDataFrame(rows, "path string, content binary")
    reasons = {r["path"][3:]: r["reason"] for r in files.intake_check(given).collect()}
    assert reasons == {
        "ok.docx": None, "long.docx": "DOCX text is too large", "cut.docx": "DOCX container is not readable",
        "part.docx": "DOCX container has no document part", "none.docx": None, "no.docx": "content does not match extension",
        "empty.docx": "size out of bounds", "null.docx": "size out of bounds", "t.txt": None}
    assert {r["reason"] for r in files.intake_check(given.filter("path like '%long%'"), most_docx=10**9).collect()} == {None}
    texts = {r["path"][3:]: (r["text"], r["extraction_status"]) for r in files.extract_text(given).collect()}
    assert texts["ok.docx"] == ("one two", "extracted") and texts["none.docx"] == ("", "no_text")
    assert texts["long.docx"] == (" ".join(["some words", ""] * 100_000), "extracted")
    assert texts["cut.docx"] == texts["part.docx"] == texts["null.docx"] == ("", "unavailable")


def test_revoked_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hour = lambda h: start + timedelta(hours=h)
    tables = {"issued": [("a", hour(0), 1), ("a", hour(4), 1), ("b", hour(1), 2), ("c", hour(1), 3), ("z", hour(90), 9)],
              "used": [("a", hour(1)), ("a", hour(3)), ("a", hour(5)), ("b", hour(0.5)), ("b", hour(1)), ("b", hour(12.9)), ("b", hour(13)),
                       ("c", hour(2)), ("c", hour(2.5)), ("d", hour(2)), ("z", hour(90))],
              "revoked": [("a", hour(2)), ("c", hour(2.25)), ("c", hour(2.4)), ("c", hour(0.5)), ("d", hour(1)), ("z", hour(91))]}
    kinds = {"issued": "token string, issued_at timestamp, user_id long", "used": "token string, used_at timestamp",
             "revoked": "token string, revoked_at timestamp"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, kinds[name]).write.parquet(str(tmp_path / name))
    streams = {n: spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in kinds.items()}
    got = jobs.run_available(jobs.session_validity(**streams), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = sorted((r["token"], (r["used_at"] - start).total_seconds() / 3600) for r in got.select("token", "used_at").collect())
    # the last use lies within the watermark
    assert found == [("a", 1.0), ("a", 5.0), ("b", 1.0), ("b", 12.9), ("c", 2.0)]
    assert got.filter(F.col("user_id").isNull()).count() == 0

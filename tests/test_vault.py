"""Audit log, search, intake, image figures, sinks and streams."""
import datetime as dt
import io
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.operators import access, audit, extraction, forensics, listing, search
from dossier.plans.intake import intake
from dossier.sources import files, sinks
from dossier.streaming import jobs

KEY = b"0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a" if i % 2 else "b", i, 5, 7, "case.updated", None, '{"k":1}', start + dt.timedelta(seconds=i))
            for i in range(1, 31)]
    events = spark.createDataFrame(rows, "chain string, id long, actor_id long, case_id long, action string, "
                                         "target_id string, details string, created_at timestamp")
    none = spark.createDataFrame([], "chain string, event_hash string")
    first = audit.append_audit(events.filter("id <= 20"), none, KEY).cache()
    second = audit.append_audit(events.filter("id > 20"), audit.chain_heads(first), KEY)
    return first.unionByName(second).cache()


def verdicts(log, heads, **kw):
    return {r.chain: r for r in audit.verify_audit(log, heads, KEY, **kw).collect()}


def test_audit_chain(spark, log):
    heads = audit.chain_heads(log)
    assert all(v.valid and v.checked == 15 for v in verdicts(log, heads, stretch=4).values())
    edited = log.withColumn("action", F.when(F.col("id") == 11, "x").otherwise(F.col("action")))
    got = verdicts(edited, heads, stretch=4)
    assert got["a"].broken_at == "11" and got["a"].checked == 5 and got["b"].valid
    cut_tail = verdicts(log.filter("id < 30"), heads)
    assert cut_tail["b"].broken_at == "head" and cut_tail["a"].valid
    hole = verdicts(log.filter("id <> 10"), heads, stretch=4)
    assert hole["b"].broken_at == "12"


def test_search(spark):
    versions = spark.createDataFrame(
        [(1, "d1", "a.txt", "the witness saw the red car"), (2, "d1", "b.txt", "nothing"),
         (3, "d2", "Witness.txt", "the car"), (4, "d3", "c.txt", "red the")],
        "version_id long, document_id string, filename string, text string")
    docs = spark.createDataFrame([("d1", 1, "T1", "fir", 1), ("d2", 1, "T2", "fir", 2), ("d3", 2, "red car", "other", 3)],
                                 "document_id string, case_id long, title string, kind string, created_on int")
    index = search.build_index(versions, KEY)

    def hits(query, **kw):
        return [r.document_id for r in search.search_documents(docs, versions, index, query, KEY, **kw).collect()]

    assert hits("red car") == ["d3", "d1"] and hits("witness") == ["d2", "d1"] and hits("absent") == []
    assert hits("the", kind="fir") == ["d2", "d1"] and hits("") == ["d3", "d2", "d1"]
    assert hits("red car", visible=spark.createDataFrame([(1,)], "case_id long")) == ["d1"]
    again = search.build_index(versions, KEY, existing=index)
    assert again.count() == 0


def test_access(spark):
    users = spark.createDataFrame([(1, "n", "admin", True), (2, "n", "auditor", True), (3, "n", "legal", True),
                                   (4, "n", "legal", True)], "user_id long, name string, role string, active boolean")
    cases = spark.createDataFrame([(10, 3, "active", False), (11, 3, "archived", True)],
                                  "case_id long, lead_user_id long, status string, legal_hold boolean")
    members = spark.createDataFrame([(10, 4, "viewer")], "case_id long, user_id long, access string")
    asks = spark.createDataFrame([(c, u) for c in (10, 11) for u in (1, 2, 3, 4)], "case_id long, user_id long")
    got = {(r.case_id, r.user_id): r.verdict for r in access.edit_rights(cases, members, users, asks).collect()}
    assert got == {(10, 1): "ok", (10, 2): "403", (10, 3): "ok", (10, 4): "403", (11, 1): "409", (11, 2): "403",
                   (11, 3): "409", (11, 4): "404"}
    assert access.visible_to(cases, members, 4, "legal").count() == 1


def docx(text):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:t>{text}</w:t></w:document>')
    return data.getvalue()


def test_intake(spark):
    rows = [("in/a.txt", b"hello witness", "d1", 0), ("in/b.docx", docx("red car"), "d1", 1),
            ("in/c.pdf", b"no pdf", "d2", 2), ("in/e.txt", b"\xff\xfe", "d2", 3), ("in/f.exe", b"MZ", "d2", 4),
            ("in/g.docx", b"PK\x03\x04broken", "d3", 5), ("in/h.txt", b"", "d3", 6)]
    table = spark.createDataFrame(rows, "path string, content binary, document_id string, arrival long")
    existing = spark.createDataFrame([("d1", 4)], "document_id string, number long")
    out = intake(table, existing, KEY)
    versions = {r.path: r for r in out["versions"].collect()}
    assert versions["in/a.txt"].number == 5 and versions["in/b.docx"].number == 6
    assert versions["in/g.docx"].extraction_status == "unavailable" and versions["in/b.docx"].extraction_status == "extracted"
    reasons = {r.path: r.reason for r in out["refused"].collect()}
    assert reasons == {"in/c.pdf": "content does not match extension", "in/e.txt": "text is not UTF-8",
                       "in/f.exe": "unsupported type", "in/h.txt": "size out of bounds"}
    assert out["index"].count() == 4


def test_blobs(spark):
    plain = spark.createDataFrame([("a" * 32 + ".vault", b"one"), ("b" * 32 + ".vault", b"two")],
                                  "storage_key string, data binary")
    stored = plain.select(F.concat(F.lit("/v/"), "storage_key").alias("path"), files.seal(F.col("data"), KEY)
                          .alias("content"))
    rows = [(1, "a" * 32 + ".vault", None), (2, "b" * 32 + ".vault", "0"), (3, "c" * 32 + ".vault", ""), (4, "x", "")]
    versions = spark.createDataFrame(rows, "version_id long, storage_key string, sha256 string").withColumn(
        "sha256", F.coalesce("sha256", F.sha2(F.lit(b"one"), 256)))
    got = {r.version_id: r.reason for r in files.verify_blobs(versions, stored, KEY).collect()}
    assert got == {1: None, 2: "hash differs from record", 3: "file missing", 4: "invalid storage key"}


def test_csv_export(spark):
    events = spark.createDataFrame([(1, "t", 'He said "hi"', "a", None, None, "h")],
                                   "id long, created_at string, actor_name string, action string, case_id long, "
                                   "target_id string, event_hash string")
    place = tempfile.mkdtemp() + "/csv"
    sinks.export_audit_csv(events, place)
    import glob
    texts = [open(p, newline="").read() for p in glob.glob(place + "/part*")]
    assert max(texts, key=len) == ('"Event ID","Timestamp","Actor","Action","Case ID","Target ID","Event hash"\r\n'
                    '"1","t","He said ""hi""","a","","","h"\r\n')
    assert sinks.quoted_line(sinks.audit_rows(events)).first().line == '"1","t","He said ""hi""","a","","","h"'


def overlap(a, b):
    wide = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    high = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return wide * high / (a[2] * a[3] + b[2] * b[3] - wide * high)


def test_overlap_suppression_equals_loop(spark):
    import random
    rng = random.Random(3)
    boxes = [("d", i, rng.randrange(300), rng.randrange(300), rng.randrange(20, 120), rng.randrange(20, 120))
             for i in range(80)]
    kept = []
    for b in boxes:
        if all(overlap(b[2:], k[2:]) < 0.3 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "document_id string, ord int, x int, y int, w int, h int")
    assert {r.ord for r in forensics.suppress_overlap(df, 0.3, 100).collect()} == {k[1] for k in kept}


def test_hot_clusters(spark):
    hot = {(2, 2): 40.0, (3, 2): 50.0, (9, 9): 60.0}
    cells = spark.createDataFrame([("d", "passport", x, y, 20, 20, v) for (x, y), v in hot.items()],
                                  "document_id string, document_type string, cx int, cy int, grid_w int, grid_h int, "
                                  "value double")
    rows = {(r.x0, r.y0): r for r in forensics.hot_clusters(cells, 13.0, 100.0).collect()}
    assert set(rows) == {(1, 1), (8, 8)} and rows[1, 1].area == 12 and rows[1, 1].median_value == 45.0
    assert rows[8, 8].area == 9 and rows[8, 8].score == 0.6


def test_displacement(spark):
    pairs = [("d", "visa", 1000, 800, 100.0 + i, 100.0, 300.0 + i, 250.0) for i in range(6)]
    df = spark.createDataFrame(pairs, "document_id string, document_type string, width int, height int, x1 double, "
                                      "y1 double, x2 double, y2 double")
    row = forensics.displacement_votes(df).first()
    assert row.votes == 6 and row.score == 0.75 and row.severity == "high"
    assert forensics.displacement_votes(df.limit(4)).count() == 0


def test_merge_lines(spark):
    rows = [("d", 1, 0, "Name A", 5, 120, 0, 1.0), ("d", 2, 0, "NAME a ", 5, 40, 100, 2.0), ("d", 2, 1, "More", 5, 99, 100, 2.0)]
    df = spark.createDataFrame(rows, "document_id string, pass_no int, line_no int, text string, x int, y int, "
                                     "offset_y int, scale double").withColumn("confidence", F.lit(50.0))
    assert {(r.text, r.pass_no) for r in extraction.merge_lines(df).collect()} == {("Name A", 1), ("More", 2)}


def test_ordinals_and_parts(spark):
    df = spark.range(0, 2500, 2).select(F.lit("k").alias("k"), F.col("id").alias("pos"))
    rows = listing.ordinals(df, ["k"], "pos", 100).orderBy("pos").collect()
    assert [r.ordinal for r in rows] == list(range(1, 1251))
    parts = listing.joined_text(df.withColumn("v", F.col("pos").cast("string")), ["k"], "v", ["pos"], ",", 200).collect()
    assert len(parts) == 7 and sorted(int(v) for p in parts for v in p.text.split(",")) == list(range(0, 2500, 2))


def lockout_loop(events):
    out, state = {}, {}
    for user, event, ts, ok in sorted(events, key=lambda e: (e[2], e[1])):
        fails, until = state.get(user, (0, None))
        if until and until > ts:
            out[event] = "rejected"
            continue
        if ok:
            state[user], out[event] = (0, None), "accepted"
        elif fails + 1 >= 5:
            state[user], out[event] = (0, ts + dt.timedelta(minutes=15)), "locked"
        else:
            state[user], out[event] = (fails + 1, until), "failed"
    return out


def test_lockouts_equal_loop(spark):
    start = dt.datetime(2024, 1, 1)
    events = [(u, u * 100 + i, start + dt.timedelta(minutes=i), i % 9 == 8) for u in (1, 2) for i in range(40)]
    # outcomes come out once the watermark has passed them; one attempt hours later passes it over all before
    later = [(3, 999, start + dt.timedelta(hours=5), False)]
    place = tempfile.mkdtemp()
    spark.createDataFrame(events + later, "user_id long, event_id long, ts timestamp, success boolean").write.parquet(place + "/in")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, success boolean").parquet(place + "/in")
    rows = jobs.run_available(jobs.lockouts(stream), place + "/out", place + "/cp").collect()
    assert {r.event_id: r.outcome for r in rows} == lockout_loop(events) and not any(r.late for r in rows)

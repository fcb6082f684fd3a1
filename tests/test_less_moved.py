"""What moves between tasks and to Python, in steps over whole documents."""
import pandas as pd

from dossier.operators import agreement, extraction, forensics, reuse
from dossier.sources.bindings import Bindings
from tests.test_less_shuffle import spy


def test_merged_lines_move_without_texts_no_one_reads(spark, capsys):
    rows = [("d", 1, 0, "Name", 0, 10, 90.0, 0, 1.0), ("d", 2, 0, " NAME", 0, 20, 80.0, 0, 2.0), ("d", 2, 1, "Name", 0, 90000, 80.0, 0, 1.0),
            ("e", 1, 0, None, 0, 10, 90.0, 0, 1.0), (None, 1, 0, "x", 0, 10, 90.0, 0, 1.0)]
    passes = spark.createDataFrame(rows, "document_id string, pass_no int, line_no int, text string, x int, y int, confidence double, "
                                         "offset_y int, scale double")
    merged = extraction.merge_lines(passes)
    assert merged.columns == ["document_id", "text", "x", "y", "confidence", "pass_no"]
    assert sorted((r.document_id or "", r.text or "", r.y, r.pass_no) for r in merged.collect()) == [
        ("", "x", 10, 1), ("d", "Name", 10, 1), ("d", "Name", 90000, 2), ("e", "", 10, 1)]
    merged.groupBy("document_id").agg({"y": "max"}).explain()
    plan = capsys.readouterr().out
    assert "min_by(" in plan and "partial_min_by(struct(text" not in plan and "hashpartitioning(document_id#" in plan


def test_boxes_without_overlap_are_not_written(spark, monkeypatch):
    written = spy(monkeypatch, forensics)
    rows = [("d", "a", 0, 0), ("d", "b", 10, 0), ("d", "c", 20, 0), ("d", "z", 900, 900), ("d", "z", 900, 900), ("e", "a", 0, 0),
            ("e", "n", None, 0), (None, "a", 0, 0), ("d", None, 0, 0)]
    boxes = spark.createDataFrame([(*r, 30, 30) for r in rows], "document_id string, ord string, x int, y int, w int, h int")
    kept = forensics.suppress_overlap(boxes, 0.4).select("document_id", "ord").collect()
    assert sorted(map(tuple, kept)) == [("d", "a"), ("d", "c"), ("d", "z"), ("d", "z"), ("e", "a"), ("e", "n")]
    assert {r.ord for df in written for r in df.select("ord").collect()} <= {"a", "b"}


def test_hashes_of_a_text_reach_python_as_one_binary(spark):
    assert reuse._votes.func(pd.Series([None, b"", b"\xff" * 8 + b"\x00" * 8 + b"\x80" + b"\x00" * 6 + b"\x01"] * 2)).tolist() == [0, 0, -(1 << 63) + 1] * 2
    assert reuse._votes.func(pd.Series([(b"\x80" + b"\x00" * 6 + b"\x01") * 2 + b"\xff" * 8])).tolist() == [-(1 << 63) + 1]
    texts = spark.createDataFrame([("a", "red red car house"), ("b", "?"), ("c", None)], "document_id string, text string")
    from hashlib import sha256
    words = [int(sha256(w.encode()).hexdigest()[:16], 16) for w in ("red", "car", "house")]
    most = sum(1 << k for k in range(64) if sum(w >> k & 1 for w in words) >= 2)
    got = {r.document_id: r.near_hash for r in reuse.with_simhash(texts).collect()}
    assert got == {"a": most - (1 << 64) if most >> 63 else most, "b": 0, "c": 0}


def test_names_meet_the_numbers_of_a_document(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1, 2, 3, 10.5, 4.0, 0.01, 0.02, "F", "R", "1997-01-02"), (1, 5, None, 3, 10.5, 4.0, 0.01, 0.02, "F", "R", "1997-01-02")],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
                          "l_tax double, l_discount double, l_linestatus string, l_returnflag string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "red car"), (1, "blue car")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    b = Bindings(spark, str(tmp_path))
    assert sorted((r.document_id, r.p_name) for r in b.printed.collect()) == [("1-1-2-3-1050", "blue car"), ("1-5-3-1050", "red car")]
    assert b.docs.columns == [c for c in b.docs.columns if not c.startswith("p_")] and b.docs.count() == 2
    b.printed.hint("merge").select("document_id", "file_name", "p_name").explain()
    above, below = capsys.readouterr().out.split("Join", 1)
    assert "concat_ws(-" in above and "concat_ws(-" not in below


def test_first_value_is_brought_to_form_once_a_case(spark, capsys):
    rows = [(1, "d1", "address", 1, "12 Main road, Pune"), (1, "d2", "address", 2, "12 MAIN ROAD pune"), (1, "d3", "address", 3, "9 hill"),
            (2, "d4", "address", 1, "?"), (2, "d5", "address", 2, "?"), (2, "d6", "full_name", 2, "x"), (3, "d7", "address", 1, "")]
    judged = agreement.name_versus_first(spark.createDataFrame(
        rows, "case_id long, document_id string, field_name string, doc_ord int, value string"), "address")
    assert {r.document_id: r.agrees for r in judged.collect()} == {"d1": True, "d2": True, "d3": False, "d4": False, "d5": False}
    judged.explain()
    above, below = capsys.readouterr().out.split("Join", 1)
    assert "lower(first_value" not in above and "lower(first_value" in below


def test_reference_reads_the_values_once(spark, capsys):
    rows = [(1, "document_number", "pan", "A1", 2, 2, (1, "d1", "A1")), (1, "document_number", "pan", "B2", 1, 1, (2, "d2", "B2")),
            (1, "document_number", "voter_id", "C3", 4, 4, (3, "d3", " C3 ")), (2, "address", "", "", 1, 0, (1, "d4", "?")),
            (None, "gender", "", "M", 1, 1, (1, "d5", "M"))]
    supported = spark.createDataFrame(rows, "case_id long, field_name string, type_key string, form string, n long, agreeing long, "
                                            "first struct<doc_ord int, document_id string, value string>")
    found = agreement.reference_value(supported)
    assert {r.case_id: (r.n_values, r.n_same_type, r.ref_form, r.ref_type, r.reference_value) for r in found.collect()} == {
        1: (7, 4, "C3", "voter_id", "C3"), 2: (1, 1, None, "", None)}
    found.explain()
    assert "Join" not in capsys.readouterr().out

"""The score is made out of all evidence: machine zones and photos reach evidence, ledger, report and figures."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dossier.functions.dates import short_date
from dossier.operators import analytics, reuse, risk
from dossier.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FINDINGS = "case_id long, severity string, pairs long"


@pytest.mark.parametrize("day, births, ends", [
    ("2024-01-31", {"24": 2024, "25": 1925, "99": 1999}, {"74": 2074, "75": 1975}),
    ("1998-06-30", {"98": 1998, "99": 1899, "01": 1901}, {"08": 2008, "48": 2048, "49": 1949})])
def test_two_digit_years_around_any_day(spark, day, births, ends):
    for kind, years in (("dob", births), ("expiry", ends)):
        for short, year in years.items():
            got = spark.range(1).select(short_date(F.lit(short + "0512"), F.lit(day).cast("date"), kind).alias("d")).first()["d"]
            assert got == dt.date(year, 5, 12), (kind, short)


def test_zones_and_photos_reach_the_ledger(spark):
    ledger = {r["factor"]: r for r in QUERIES["risk_ledger"](spark, FOLDER).groupBy("factor").agg(
        F.count("*").alias("cases"), F.min("score").alias("least"), F.first("explanation").alias("text")).collect()}
    assert {"mrz_checksum_fail", "face_mismatch", "document_reuse"} <= set(ledger)
    assert ledger["mrz_checksum_fail"]["least"] == 20 and ledger["face_mismatch"]["least"] >= 35
    assert ledger["document_reuse"]["text"].endswith("match(es) found).")
    sections = {r["section"] for r in QUERIES["key_findings"](spark, FOLDER).select("section").distinct().collect()}
    assert 4 in sections
    modules = {r["module"] for r in QUERIES["report_modules"](spark, FOLDER).select("module").distinct().collect()}
    assert "Facial cross-matching" in modules


def test_photo_findings_count_their_pairs(spark):
    faces = reuse.face_rows(spark.createDataFrame([(1, "high", 3), (1, "info", 2), (2, "medium", 1), (3, "info", 1)], FINDINGS))
    none = spark.createDataFrame([], "case_id long, document_id string, severity string, check_type string, status string, n_fields long, doc_ord int")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    evidence = risk.case_evidence(cases, none, faces, none, none, none)
    got = {r["case_id"]: r for r in evidence.collect()}
    assert (got[1]["face_mismatch"], got[2]["face_mismatch"], got[3]["face_info"]) == (3, 1, 1)
    ledger = {(r["case_id"], r["factor"]): r["score"] for r in risk.risk_ledger(evidence).collect()}
    assert ledger[1, "face_mismatch"] == 105 and ledger[3, "face_matched"] == -5 and (1, "face_matched") not in ledger
    ranked = {r["field_name"]: r for r in analytics.discrepancy_ranking(faces).collect()}
    assert (ranked["facial_photo"]["count"], ranked["facial_photo"]["high"]) == (7, 3)


def test_each_copy_lists_its_first_other_holders(spark):
    rows = [(k, k % 4, "h" if k < 9 else "one" if k == 9 else "two" if k < 12 else None) for k in range(14)]
    docs = spark.createDataFrame(rows, "document_id long, case_id long, file_hash string")
    got = {}
    for r in reuse.listed_hits(docs).collect():
        assert r["other_case_id"] == r["other_document_id"] % 4
        got.setdefault(r["document_id"], {})[r["rank"]] = r["other_document_id"]
    want = {k: dict(enumerate([x for x in range(9) if x != k][:5], 1)) for k in range(9)}
    assert got == {**want, 10: {1: 11}, 11: {1: 10}}
    assert reuse.listed_hits(docs.limit(0)).count() == 0

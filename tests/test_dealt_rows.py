"""Rows dealt once by case or document: the same rows, and what groups by that key moves nothing more."""
from __future__ import annotations

from collections import Counter

import pytest

from dossier.operators import agreement, fusion, validation
from dossier.sources import bindings
from dossier.sources.bindings import Bindings

SOLD = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture
def bound(spark, tmp_path):
    rows = [(n // 4, n % 5, n % 3, n % 7 + 1, float(n), n * 1.25, 0.05, 0.01 * (n % 4), "ANR"[n % 3], "FO"[n % 2], None)
            for n in range(40)]
    rows += [rows[3], rows[3], (None, *rows[5][1:]), (None, None, *rows[6][2:])]
    spark.createDataFrame(rows, SOLD).selectExpr(
        "* except (l_shipdate)", "timestamp'1997-01-05' + make_interval(0, 0, 0, l_partkey) l_shipdate").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n, f"name{n} of part{n % 2}") for n in range(5)], "p_partkey long, p_name string").write.parquet(
        f"{tmp_path}/part.parquet")
    return Bindings(spark, str(tmp_path))


def rows_of(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def own_exchanges(df, capfd, key):
    """Exchanges by a key that Spark adds to those the code asks for."""
    df.explain()
    plan = capfd.readouterr().out
    return [line for line in plan.splitlines() if f"Exchange hashpartitioning({key}" in line and "ENSURE_REQUIREMENTS" in line]


def test_rows_by_case(bound, capfd):
    assert rows_of(bound.fields_by_case) == rows_of(bound.fields)
    values = agreement.field_values(bound.fields_by_case)
    assert rows_of(values) == rows_of(agreement.field_values(bound.fields))
    assert not own_exchanges(values, capfd, "case_id")


def test_rows_by_document(bound, capfd):
    assert rows_of(bound.docs_by_document) == rows_of(bound.docs)
    wide = validation.by_document(bound.docs_by_document, bound.fields_by_document)
    assert rows_of(wide) == rows_of(validation.by_document(bound.docs, bound.fields))
    assert not own_exchanges(wide, capfd, "document_id")


def test_a_hot_case_is_not_put_in_one_task(bound, monkeypatch):
    monkeypatch.setattr(bindings, "CASE_ROWS", 3)
    assert bound.fields_by_case is bound.fields


def test_findings_of_parts(bound):
    values = agreement.field_values(bound.fields)
    parts = agreement.consistency(*agreement.cluster_parts(values))
    whole = agreement.consistency(agreement.clusters(values))
    assert whole.count() > 5 and rows_of(parts) == rows_of(whole)


def test_votes_stay_with_their_case(spark, bound, capfd):
    fused = spark.createDataFrame(
        [(1, "full_name", "name1 of part1"), (1, "gender", "Male"), (1, "address", ""), (2, "gender", "Female"), (None, "gender", "Male")],
        "case_id long, field_name string, consensus_value string")
    edges = fusion.graph_edges(bound.docs, bound.fields_by_case, fused)
    assert not [line for line in own_exchanges(edges, capfd, "case_id") if "field_name" in line]
    votes = [r for r in edges.collect() if r.label != "submitted"]
    wanted = {(r.case_id, r.field_name) for r in fused.collect() if r.consensus_value and r.case_id}
    assert {(r.case_id, r.target.removeprefix("field-")) for r in votes} == wanted
    for r in votes:
        if r.target == "field-gender":
            assert r.status == ("agree" if r.label == {1: "Male", 2: "Female"}[r.case_id] else "conflict")
    assert len(votes) == bound.fields.join(fused.filter("consensus_value <> ''"), ["case_id", "field_name"]).count()

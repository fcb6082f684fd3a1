"""What lies together stays so: groups are folded where they are, the wide table keeps its documents, zone lines move once."""
from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.operators import agreement, notices, validation
from dossier.plans.screening import Screening
from dossier.session import cut_by
from dossier.sources.bindings import Bindings, as_of
from test_dealt_rows import SOLD, bound, own_exchanges, rows_of  # noqa: F401


def test_groups_fold_where_they_are(spark, bound, capfd):  # noqa: F811
    rng, rows = random.Random(5), []
    for n in range(400):
        case = rng.choice([1, 2, 2, 2, None])
        name = f"{rng.choice('abcdefghij')}{rng.choice('klmnopqr')}x {rng.choice('stuvwxyz')}{rng.choice('abcdef')}y" if n % 9 else "--"
        rows.append((case, f"d{n}", "pan", "f", n, rng.choice(["full_name", "gender"]), name))
    fields = spark.createDataFrame(rows, "case_id long, document_id string, document_type string, file_name string, doc_ord int, "
                                         "field_name string, value string")
    values = agreement.field_values(fields)
    assert values.filter("case_id = 2 and field_name = 'full_name'").count() > agreement.FOLD_VALUES
    for apart, near in zip(agreement.cluster_parts(values), agreement.cluster_parts(values, together=True)):
        assert near.columns == apart.columns and rows_of(near) == rows_of(apart)
    own = agreement.cluster_parts(agreement.field_values(bound.fields_by_case), together=True)[1]
    assert not own_exchanges(own, capfd, "case_id")


def test_wide_table_keeps_its_documents(bound, capfd):  # noqa: F811
    rows = validation.by_document(bound.docs_by_document, bound.fields_by_document)
    wide = cut_by(rows, "document_id", bound.parts)
    assert rows_of(wide) == rows_of(rows) and rows_of(bound.payloads_by_document) == rows_of(bound.payloads)
    checks = validation.qr_compare(bound.payloads_by_document, wide.hint("merge"))
    assert not own_exchanges(checks, capfd, "document_id")
    assert rows_of(checks) == rows_of(validation.qr_compare(bound.payloads, rows))
    spark = wide.sparkSession
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]


def test_notices_read_failed_checks_and_the_wide_table(bound):  # noqa: F811
    cases = bound.docs.select("case_id").distinct()
    s = Screening(cases, bound.docs, bound.fields_by_case, as_of(), bound.forensics, bound.payloads_by_document,
                  by_document=(bound.docs_by_document, bound.fields_by_document), document_parts=bound.parts, together=True)
    failed = s.validations.filter("status = 'fail'")
    assert failed.count() and rows_of(s.failed_table) == rows_of(failed)
    found = notices.discrepancies(s.findings_table, s.failed_table, bound.forensics, s.wide)
    plain = Screening(cases, bound.docs, bound.fields, as_of(), bound.forensics, bound.payloads)
    assert rows_of(found) == rows_of(notices.discrepancies(plain.findings, plain.validations, bound.forensics, bound.docs))


@pytest.mark.parametrize("block", [4, 1000])
def test_zone_pairs_over_blocks(spark, monkeypatch, capfd, block):
    monkeypatch.setattr(validation, "PAIR_BLOCK", block)
    one = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
    two = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    noise = "P<XXX<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<"
    rows = []
    for doc in range(24):  # the zone begins at any place of a block, its second line up to three lines on
        lines = [noise] * 24
        lines[doc - doc % 2] = one
        lines[min(doc - doc % 2 + 1 + doc % 3, 23)] = two
        rows += [(f"d{doc}", 5 * n, text) for n, text in enumerate(lines)]
    rows += [("alone", 0, one), ("alone", 1, two)]
    lines = spark.createDataFrame(rows, "document_id string, line_no int, text string")
    got = {r.document_id: (r.document_number, r.passed) for r in validation.mrz_parse(lines, as_of()).collect()}
    assert got["alone"][0] == "L898902C3" and Counter(got.values()) == {got["alone"]: 25}
    validation.mrz_parse(lines, as_of()).explain()
    assert "[1,2,3]" not in capfd.readouterr().out  # no copies of a line for the lines it may meet

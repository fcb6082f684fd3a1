"""What moves between tasks: steps write and shuffle only what their readers need."""
from dossier.operators import agreement, analytics, forensics, reuse, rules, search, validation
from dossier.session import PART_BYTES, size_parts

FIELDS = ("case_id long, document_id string, document_type string, file_name string, doc_ord int, field_name string, "
          "value string")
KEY = b"k" * 32


def spy(monkeypatch, module):
    """Tables that a module writes, as it writes them."""
    seen, true = [], module.cut

    def cut(df):
        seen.append(df)
        return true(df)

    monkeypatch.setattr(module, "cut", cut)
    return seen


def fields_of(spark):
    rows = [(1, f"d{n}", "pan", f"f{n}.png", n, f, v) for n, values in enumerate([
        {"full_name": "R SHARMA", "gender": "M", "issue_date": "2020-01-01"},
        {"full_name": "RAHUL SHARMA", "gender": "F", "issue_date": "01/01/2020"}, {"address": "?"}, {"address": "?"}])
        for f, v in values.items()]
    return spark.createDataFrame(rows, FIELDS)


def test_clusters_write_names_and_addresses_only(spark, monkeypatch):
    written = spy(monkeypatch, agreement)
    rows = agreement.consistency(agreement.clusters(agreement.field_values(fields_of(spark)))).collect()
    assert {r.field_name: r.n_clusters for r in rows} == {"full_name": 1, "gender": 2, "issue_date": 1, "address": 2}
    assert {r.field_name for df in written for r in df.select("field_name").collect()} == {"full_name", "address"}


def test_plain_fields_carry_no_first_document(spark, capsys):
    agreement.consistency(agreement.clusters(agreement.field_values(fields_of(spark)))).explain()
    assert "min(struct(pos" not in capsys.readouterr().out


def test_age_rule_reads_births_once(spark, monkeypatch):
    written = spy(monkeypatch, rules)
    docs = spark.createDataFrame([(1, "d0", "voter_id", "f0.png", 0)],
                                 "case_id long, document_id string, document_type string, file_name string, doc_ord int")
    fields = spark.createDataFrame([(1, "d0", "voter_id", "f0.png", 0, f, v) for f, v in (
        ("date_of_birth", "2006-05-10"), ("issue_date", "2016-01-15"))], FIELDS)
    row = rules.rule_age(validation.by_document(docs, fields)).first()
    assert row.status == "fail" and "9 years old" in row.explanation
    assert [df.count() for df in written] == [1]


def test_only_shared_hashes_are_grouped(spark, monkeypatch):
    written = spy(monkeypatch, reuse)
    docs = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 2, "y"), ("d", 3, ""), ("e", 3, None), ("f", 3, "")],
                                 "document_id string, case_id long, file_hash string")
    rows = {r.document_id: (r.hits, r.other_document_id, r.same_case) for r in reuse.same_hash(docs).collect()}
    assert rows == {"a": (1, "b", False), "b": (1, "a", False)}
    assert [df.count() for df in written] == [1]


def test_search_moves_only_the_words_asked_for(spark, monkeypatch):
    written = spy(monkeypatch, search)
    index = search.build_index(spark.createDataFrame([(1, "red car house"), (2, "red tree"), (3, "red car")], "version_id long, text string"), KEY)
    asked = spark.createDataFrame([(7, "red car"), (8, "tree"), (9, "red cloud"), (10, "")], "query_id long, text string")
    found = {(r.query_id, r.version_id) for r in search.all_terms(index, search.query_words(asked, KEY)).collect()}
    assert found == {(7, 1), (7, 3), (8, 2)}
    assert [df.count() for df in written] == [4]


def test_cells_are_not_broadcast(spark, monkeypatch, capsys):
    written = spy(monkeypatch, forensics)
    cells = spark.createDataFrame([("d", "pan", x, 1, 9, 9, 50.0) for x in range(1, 5)],
                                  "document_id string, document_type string, cx int, cy int, grid_w int, grid_h int, value double")
    found = forensics.hot_clusters(cells, 47.0, 60.0)
    assert [(r.area, r.x0, r.cells_w) for r in found.collect()] == [(18, 0, 6)]
    for df in [*written, found]:
        df.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_ranking_is_written_once(spark, monkeypatch):
    written = spy(monkeypatch, analytics)
    findings = spark.createDataFrame([(1, "gender", "high"), (2, "gender", "info")], "case_id long, field_name string, severity string")
    rows = {r.field_name: (r["count"], r.percentage) for r in analytics.discrepancy_ranking(findings).collect()}
    assert rows["gender"] == (2, 100.0) and len(written) == 1


def test_unasked_fields_stay_where_they_are(spark, capsys):
    fields = fields_of(spark)
    docs = fields.select("case_id", "document_id", "document_type").distinct()
    found = validation.missing_required(docs, fields.filter("field_name != 'gender'"), {"pan": ("full_name",)})
    assert {r.document_id for r in found.collect()} == {"d2", "d3"}
    found.explain()
    assert "field_name#" in (plan := capsys.readouterr().out) and "= full_name)" in plan


def test_parts_grow_with_the_input(spark):
    first, split = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name, None) for name in (first, split)}
    try:
        spark.conf.unset(first)
        spark.conf.set(split, "32MB")
        size_parts(spark, PART_BYTES)
        assert spark.conf.get(first, None) is None and spark.conf.get(split) == "32MB"
        size_parts(spark, 1000 * PART_BYTES)
        assert spark.conf.get(first) == "1000"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

"""Exported sections come back as written: quotes, commas, line ends, empty and missing values."""
from __future__ import annotations

from dossier.sources import sinks


def sections(spark, rows):
    kpis = spark.createDataFrame([(3, 1, 1, 1, 33.3, None, 12, 9, 0)], "total_cases long, valid_count long, review_count long, "
                                 "high_risk_count long, pass_rate double, average_risk_score double, avg_processing_time_ms long, "
                                 "total_documents long, face_checks long")
    trend = spark.createDataFrame([("2024-01-01", 1, 0, 0, 1)], "slot string, valid long, under_review long, high_risk long, total long")
    ranking = spark.createDataFrame(rows, "label string, count long, percentage double")
    types = spark.createDataFrame([("PAN Card", 2, 50.0, 100.0, 0.5), (None, 1, 25.0, 0.0, None)],
                                  "label string, count long, percentage double, pass_rate double, avg_confidence double")
    return sinks.analytics_sections(kpis, trend, ranking, types)


def lines(spark, own, folder):
    return {(r["section"], r["is_row"], r["line"]) for r in sinks.exported_lines(spark, own, folder).collect()}


def test_sections_come_back_whole(spark, tmp_path):
    own = sections(spark, [('say "so", \\ then', 1, 50.0), ("", 1, 50.0), (None, 0, 0.0)])
    sinks.export_analytics(own, f"{tmp_path}/all/")
    got = lines(spark, own, f"{tmp_path}/all")
    assert {x for x in got if x[0] == "ranking"} == {
        ("ranking", False, '"DISCREPANCY FIELD","OCCURRENCE COUNT","PERCENTAGE OF TOTAL CONFLICTS"'),
        ("ranking", True, '"say ""so"", \\ then","1","50.0%"'), ("ranking", True, '"","1","50.0%"'), ("ranking", True, '"","0","0.0%"')}
    assert ("kpis", True, '"Average Risk Index (0-100)",""') in got and ("kpis", True, '"Average Processing Duration","12 ms"') in got
    assert ("types", True, '"PAN Card","2","50.0%","100.0%","0.50"') in got and ("types", True, '"","1","25.0%","0.0%",""') in got
    assert len(got) == 4 + 9 + 1 + 3 + 2


def test_a_section_without_rows_has_its_titles(spark, tmp_path):
    own = sections(spark, [])
    sinks.export_analytics(own, str(tmp_path / "none"))
    assert [x[1] for x in lines(spark, own, str(tmp_path / "none")) if x[0] == "ranking"] == [False]

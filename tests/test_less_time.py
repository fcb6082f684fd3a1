"""Texts are read once: lines by the zones, tokens by a pair of names; generated methods stay short enough to be compiled."""
from pyspark.sql import functions as F

from dossier import session
from dossier.functions import dates, text
from dossier.operators import agreement, validation


def test_zones_read_the_lines_once(spark):
    rows = [("d", 8, "P<INDDOE<<ANNA".ljust(44, "<")), ("d", 9, "SR00000017IND9001015F3001012<<<<<<<<<<<<<<00"), ("e", 1, "no zone")]
    seen = spark.sparkContext.accumulator(0)
    lines = spark.sparkContext.parallelize(rows, 1).map(lambda r: (seen.add(1), r)[1]).toDF("document_id string, line_no int, text string")
    zones = validation.mrz_parse(lines, F.lit("2024-01-31").cast("date")).collect()
    assert seen.value == len(rows)
    assert [(z["document_id"], z["surname"], z["given_names"]) for z in zones] == [("d", "DOE", "ANNA")]


def test_tokens_are_made_once_for_a_pair(spark):
    pairs = spark.createDataFrame([
        ("Anna Maria Doe", "DOE A", True), ("A. Doe", "anna doe", False), ("Anna", "", False), ("É Ana", "e ana", True),
        ("a\tb", " B  a", True), ("Bob", "b", True), ("Bob Ray", "Bo Ray", False)], "a string, b string, same boolean")
    got = pairs.select("a", "b", "same", text.names_match("a", "b").alias("m"))
    assert all(r["m"] == r["same"] for r in got.collect())
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2


def test_forms_are_split_once_for_a_pair(spark):
    rows = spark.createDataFrame([("address", "12 main road", "12 main"), ("full_name", "A DOE", "ANNA DOE"), ("gender", "F", "M")],
                                 "f string, a string, b string")
    got = rows.select(agreement.forms_agree(F.col("f"), F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in got.collect()] == [True, True, False]
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 2


def test_address_tokens_and_dates(spark):
    row = spark.range(1).select(
        text.address_tokens(F.lit("12-B, Main  Rd; a ÉCOLE x1")).alias("t"), text.fold_ascii(F.lit("Ünïé x")).alias("f"),
        text.fold_ascii(F.unhex(F.lit("41FF42")).cast("string")).alias("broken"),
        *[dates.parse_date(F.lit(d)).cast("string").alias(f"d{k}") for k, d in enumerate(
            ("31/12/1999", "1.2.2000\n", " 01-02-2000;", "32/01/2000", "2000-02-30", "5 mar 2001"))]).first()
    assert row["t"] == ["12", "cole", "main", "rd", "x1"] and (row["f"], row["broken"]) == ("Unie x", "AB")
    assert [row[f"d{k}"] for k in range(6)] == ["1999-12-31", "2000-02-01", "2000-02-01", None, None, "2001-03-05"]


def test_long_methods_are_cut(spark):
    key, given = "spark.sql.codegen.hugeMethodLimit", {n: spark.conf.get(n, None) for n in session.SMALL_PARTS}
    spark.conf.unset(key)
    session.size_parts(spark, 0)
    assert spark.conf.get(key) == "8000"
    spark.conf.set(key, "9000")
    session.size_parts(spark, 0)
    assert spark.conf.get(key) == "9000"
    spark.conf.unset(key)
    for name, value in given.items():
        spark.conf.set(name, value) if value else spark.conf.unset(name)

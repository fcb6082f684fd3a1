import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from dossier.functions import crypto, dates, shapes, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names(spark):
    pairs = [("R SHARMA", "RAHUL SHARMA", True), ("RAHUL SHARMA", "Rahul  Sharma", True),
             ("RAHUL SHARMA", "RAHUL VERMA", False), ("", "RAHUL", False), ("José Nuñez", "JOSE NUNEZ", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.names_match("a", "b").alias("got")).collect())


def test_folding_covers_ligatures(spark):
    row = one(spark, text.normalize_name(F.lit("  ﬁancé\tĲssel ß ")).alias("v"), text.fold_ascii(F.lit("½")).alias("h"))
    assert row.v == "FIANCE IJSSEL" and row.h == "12"


def test_addresses(spark):
    base = F.lit("14 Lakeview Road, Pune 411001")
    row = one(spark, text.addresses_match(base, F.lit("14 lakeview road pune 411001 oo eae")).alias("same"),
              text.addresses_match(base, F.lit("7 Hill Street Delhi")).alias("other"),
              text.addresses_match(F.lit("?"), F.lit("?")).alias("empty"))
    assert (row.same, row.other, row.empty) == (True, False, False)


def test_dates(spark):
    values = {"12/05/2001": "2001-05-12", "02-02-2033": "2033-02-02", "1.2.1999": "1999-02-01", "12 May 2001":
              "2001-05-12", "3 september 2010": "2010-09-03", "2001-05-12": "2001-05-12", "12052001": "2001-05-12",
              "2033/02/02": None, "31/02/2001": None, "no date": None, " 12/05/2001,": "2001-05-12"}
    df = spark.createDataFrame(list(values.items()), "v string, want string")
    for row in df.select("v", "want", dates.date_text("v").alias("got")).collect():
        assert row.got == row.want, row
    short = one(spark, dates.short_date(F.lit("010512"), F.lit("2024-01-01").cast("date")).alias("young"),
                dates.short_date(F.lit("600512"), F.lit("2024-01-01").cast("date")).alias("old"),
                dates.short_date(F.lit("600512"), F.lit("2024-01-01").cast("date"), "expiry").alias("ends"))
    assert (short.young, short.old, short.ends) == (dt.date(2001, 5, 12), dt.date(1960, 5, 12), dt.date(2060, 5, 12))


def test_check_digits(spark):
    row = one(spark, shapes.check_digit(F.lit("012346")), shapes.check_digit(F.lit("A")),
              shapes.check_digit(F.lit("<<<")), shapes.check_digit(F.lit("a")))
    assert tuple(row) == ("6", "0", "0", None)


def test_similarity(spark):
    assert text.ratio("Rahul Sharma", "Sharma Rahul") == 1.0
    assert text.ratio("Mohammad Ali", "Mohamed Ali") >= 0.85
    assert text.ratio("Rahul Sharma", "Vikram Singh") < 0.5
    row = one(spark, text.string_similarity(F.lit("Mohammad Ali"), F.lit("Mohamed Ali")).alias("v"))
    assert row.v == text.ratio("Mohammad Ali", "Mohamed Ali")


def test_hmac_equals_python(spark):
    key = b"k" * 80
    row = one(spark, crypto.hmac_sha256(F.lit("search:witness"), key).alias("v"))
    assert row.v == hmac.new(key, b"search:witness", hashlib.sha256).hexdigest()


def test_sealed_text(spark):
    key = b"0" * 32
    sealed = spark.createDataFrame([("secret",), ("",)], "t string").select(
        "t", crypto.encrypt_text("t", key, "a").alias("s"))
    rows = sealed.select("t", "s", crypto.decrypt_text("s", key, "a").alias("back")).collect()
    assert all(r.t == r.back for r in rows) and rows[1].s == ""
    plain = one(spark, crypto.decrypt_text(F.lit("plain"), key, "a").alias("v"))
    assert plain.v is None


def test_boxes_and_hashes(spark):
    box = [F.lit(v) for v in (0, 0, 10, 10)]
    row = one(spark, shapes.iou(box, [F.lit(v) for v in (5, 0, 10, 10)]).alias("o"),
              shapes.iou(box, [F.lit(v) for v in (20, 0, 10, 10)]).alias("none"),
              shapes.hamming(shapes.hash_bits(F.lit("ffffffffffffffff")), shapes.hash_bits(F.lit("fffffffffffffff0")))
              .alias("h"), shapes.hash_bits(F.lit("xyz")).alias("bad"))
    assert abs(row.o - 1 / 3) < 1e-9 and row.none == 0 and row.h == 4 and row.bad is None


def test_label_noise(spark):
    row = one(spark, text.strip_name_label(F.lit("Full Name: name RAHUL")).alias("v"),
              text.base_name(F.lit("a\\b/c.TXT")).alias("b"), text.extension(F.lit("c.TXT")).alias("e"))
    assert (row.v, row.b, row.e) == ("RAHUL", "c.TXT", ".txt")

"""Domain tables made from the given parquet tables (the shapes of FIXTURES.md).

Documents are keyed by the natural key of their source row instead of a running
number, so that no window over one case is needed.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossier.functions.shapes import check_digit
from dossier.session import explode_present
from dossier.sources import tables

AS_OF = "1998-06-30"
EVENTS_AS_OF = "2024-01-31 00:00:00"
TYPES = ("passport", "national_id", "pan", "driving_licence", "voter_id", "address_proof")
CASE_ROWS = 100_000  # documents of a case that one task may get


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _document_id() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws("-", *[c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                                                         F.col("l_suppkey"), cents)])


class Bindings:
    """Lazily built domain tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.folder, name)

    @cached_property
    def users(self) -> DataFrame:
        role = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "admin")
                .when(F.col("c_mktsegment") == "MACHINERY", "auditor")
                .when(F.col("c_mktsegment") == "BUILDING", "legal").otherwise("investigator"))
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), role.alias("role"),
            (F.col("c_acctbal") >= 0).alias("active"))

    @cached_property
    def cases(self) -> DataFrame:
        key, risk = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 5000).cast("int")
        done = F.when(key % 3 == 0, "archived").otherwise("closed")
        created = F.col("o_orderdate").cast("date")
        return self.raw("orders").select(
            key.alias("case_id"), F.concat(F.lit("CASE/"), key.cast("string")).alias("reference"),
            F.concat(F.lit("Matter "), F.col("o_orderpriority")).alias("title"),
            F.concat(F.lit("Opened for customer "), F.col("o_custkey").cast("string")).alias("description"),
            F.col("o_custkey").alias("lead_user_id"),
            F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "under_review")
            .otherwise(done).alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "restricted")
            .when(F.col("o_orderpriority") == "2-HIGH", "confidential").otherwise("internal")
            .alias("classification"),
            (F.col("o_orderpriority") == "1-URGENT").alias("legal_hold"),
            created.alias("created_on"),
            F.when(key % 5 != 0, F.date_add(created, 730)).alias("retention_until"),
            F.when(key % 50 != 0, risk).alias("overall_risk"),
            F.when(key % 50 == 0, F.lit(None)).when(key % 37 == 0, "unable_to_verify")
            .when(risk <= 29, "verification_passed").when(risk <= 59, "review_recommended")
            .otherwise("manual_review_required").alias("recommendation"))

    @cached_property
    def members(self) -> DataFrame:
        access = F.when(F.col("l_returnflag") == "R", "editor").otherwise("viewer")
        return self.raw("lineitem").groupBy(
            F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("user_id")).agg(
            F.min(access).alias("access"))

    @cached_property
    def lines_sold(self) -> DataFrame:
        return tables.read_spread(self.spark, self.folder, "lineitem")

    @cached_property
    def texts(self) -> DataFrame:
        return tables.read_spread(self.spark, self.folder, "documents")

    def _keyed(self, sold: DataFrame) -> DataFrame:
        """Rows of the documents as they are read, with the key of the name printed on them."""
        parts = self.raw("part").agg(F.count("*")).scalar()
        later = F.when(F.col("l_linenumber") == 5, 1).otherwise(0)
        return sold.select("*", ((F.col("l_orderkey") + later) % parts).alias("name_key"))

    @cached_property
    def _sold(self) -> DataFrame:
        return self._keyed(self.lines_sold)

    @cached_property
    def parts(self) -> int:
        return tables.parts_of(self.spark, self.folder, "lineitem")

    @cached_property
    def has_hot_case(self) -> bool:
        """Whether a case holds so many documents that no task should get them all."""
        sizes = self.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        return not sizes.filter(F.col("n") > CASE_ROWS).isEmpty()

    def _as_docs(self, sold: DataFrame, *more: str) -> DataFrame:
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        shipped = F.col("l_shipdate").cast("date")
        kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_partkey") % 6 + 1).cast("int"))
        return sold.select(
            key.alias("case_id"), _document_id().alias("document_id"), line.alias("doc_ord"), kind.alias("document_type"),
            (60 + F.col("l_quantity") * 0.8).alias("confidence"),
            F.concat(F.lit("scan-"), line.cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                     F.lit(".png")).alias("file_name"),
            F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                               F.col("l_quantity").cast("int").cast("string")), 256).alias("file_hash"),
            "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_tax", "l_discount", "l_quantity",
            shipped.alias("issue_d"),
            F.date_add(shipped, F.when(line == 7, -1).otherwise(3650)).alias("expiry_d"),
            F.date_add(F.lit("1960-01-01").cast("date"),
                       (key % 15000 + F.when(line == 6, 1).otherwise(0)).cast("int")).alias("dob_d"),
            "name_key", *more)

    @cached_property
    def docs(self) -> DataFrame:
        return self._as_docs(self._sold)

    def _named(self, sold: DataFrame) -> DataFrame:
        return sold.join(self.raw("part").select(F.col("p_partkey").alias("name_key"), "p_name"), "name_key")

    @cached_property
    def printed(self) -> DataFrame:
        """Documents with the values printed on them; the numbers of a row meet the names, its texts are made after."""
        return self._as_printed(self._named(self._sold))

    def _as_printed(self, named: DataFrame) -> DataFrame:
        name, line = F.col("p_name"), F.col("doc_ord")
        day_first = F.date_format("dob_d", "dd/MM/yyyy")
        short = F.concat(F.substring(name, 1, 1), F.lit(" "), F.substring_index(name, " ", -1))
        kind, number = F.col("document_type"), F.col("l_partkey")
        return self._as_docs(named, "p_name").select(
            "*",
            F.when(line == 3, short).when(line % 2 == 0, F.upper(name)).otherwise(name).alias("full_name"),
            F.when(line % 2 == 0, day_first).otherwise(F.col("dob_d").cast("string")).alias("date_of_birth"),
            F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("gender"),
            F.when(line != 4, F.col("l_returnflag")).alias("nationality"),
            F.when(kind == "pan", F.concat(F.lit("ABCP"), F.upper(F.substring(name, 1, 1)),
                                           F.lpad((number % 10000).cast("string"), 4, "0"), F.lit("F")))
            .when(kind == "passport", F.concat(F.lit("SR"), F.lpad(number.cast("string"), 7, "0")))
            .otherwise(number.cast("string")).alias("document_number"),
            F.concat((F.col("case_id") % 90 + 10).cast("string"), F.lit(" "), name, F.lit(" road "),
                     F.when(line == 2, "oo, eae").otherwise("pune")).alias("address"))

    @cached_property
    def fields(self) -> DataFrame:
        """Extracted fields in long form, one scan of the documents."""
        return self._as_fields(self.printed)

    @cached_property
    def fields_by_case(self) -> DataFrame:
        """The same rows, those of a case in one task: numbers and names are dealt, so what groups by case moves no texts.

        Where a case is too large for that the rows stay as they are and meet by partial sums.
        """
        if self.has_hot_case:
            return self.fields
        return self._as_fields(self._as_printed(self._named(self._keyed(self.raw("lineitem"))).repartition(
            self.parts, "l_orderkey")))

    @cached_property
    def docs_by_document(self) -> DataFrame:
        return self._as_docs(self._keyed(self.raw("lineitem")).repartition(self.parts, _document_id()))

    @cached_property
    def fields_by_document(self) -> DataFrame:
        """The same rows, those of a document in one task."""
        return self._as_fields(self._printed_by_document)

    @cached_property
    def _printed_by_document(self) -> DataFrame:
        return self._as_printed(self._named(self._keyed(self.raw("lineitem"))).repartition(self.parts, _document_id()))

    def _as_fields(self, printed: DataFrame) -> DataFrame:
        def entry(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("field_name"), value.alias("value"))

        entries = [
            *[entry(n, F.col(n)) for n in ("full_name", "date_of_birth", "gender", "nationality",
                                           "document_number", "address")],
            entry("issue_date", F.col("issue_d").cast("string")),
            entry("expiry_date", F.col("expiry_d").cast("string"))]
        return explode_present(printed, ["case_id", "document_id", "document_type", "file_name", "doc_ord",
                                         "confidence"], entries, "value")

    @cached_property
    def payloads(self) -> DataFrame:
        """Texts of the codes printed on documents; some differ from the print, some are no objects."""
        return self._as_payloads(self.printed)

    @cached_property
    def payloads_by_document(self) -> DataFrame:
        """The same rows, those of a document in one task."""
        return self._as_payloads(self._printed_by_document)

    def _as_payloads(self, printed: DataFrame) -> DataFrame:
        number = F.when(F.col("l_tax") < 0.02, F.concat(F.lit("X"), F.col("document_number"))) \
            .otherwise(F.col("document_number"))
        born = F.when(F.col("l_discount") > 0.08, F.date_add("dob_d", 1)).otherwise(F.col("dob_d"))
        text = F.to_json(F.struct(number.alias("doc"), F.upper("p_name").alias("name"),
                                  F.date_format(born, "dd/MM/yyyy").alias("dob")))
        return printed.filter(F.col("doc_ord") % 3 != 0).select(
            "document_id", F.when(F.col("doc_ord") == 5, F.lit("[1, 2]")).otherwise(text).alias("payload"))

    @cached_property
    def lines(self) -> DataFrame:
        """Recognised text lines of the documents, passports with a machine-readable zone."""
        name, passport = F.upper("p_name"), F.col("document_type") == "passport"
        parts = self.printed.withColumns({
            "_number": F.rpad("document_number", 9, "<"), "_born": F.date_format("dob_d", "yyMMdd"),
            "_ends": F.date_format("expiry_d", "yyMMdd"),
            "_own": F.rpad(F.col("l_suppkey").cast("string"), 14, "<")})
        wrong = F.when(F.col("l_tax") < 0.02, 1).otherwise(0)
        digits = parts.withColumns({
            "_head": F.when(passport, F.concat("_number", ((check_digit("_number").cast("int") + wrong) % 10)
                                               .cast("string"))),
            "_middle": F.when(passport, F.concat("_born", check_digit("_born"))),
            "_tail": F.when(passport, F.concat("_ends", check_digit("_ends"), "_own", check_digit("_own")))})
        whole = digits.withColumn("_all", F.concat("_head", "_middle", "_tail"))
        zone1 = F.rpad(F.concat(F.lit("P<IND"), F.substring_index(name, " ", -1), F.lit("<<"),
                                F.substring_index(name, " ", 1)), 44, "<")
        zone2 = F.concat("_head", F.lit("IND"), "_middle", F.substring("gender", 1, 1), "_tail", check_digit("_all"))

        def line(number: int, text: Column, y: int) -> Column:
            return F.struct(F.lit(number).alias("line_no"), text.alias("text"), F.lit(y).alias("y"))

        texts = [
            line(0, F.concat(F.lit("REPUBLIC REGISTRY ADDRESS "), F.upper("document_type")), 10),
            line(1, F.concat(F.lit("Full Name: "), F.col("full_name")), 150),
            line(2, F.concat(F.lit("Date of Birth "), F.date_format("dob_d", "dd/MM/yyyy")), 214),
            line(3, F.concat(F.lit("Gender: "), F.col("gender")), 278),
            line(4, F.concat(F.lit("ID Number: "), F.col("document_number")), 342),
            line(5, F.concat(F.lit("Date of Issue "), F.date_format("issue_d", "dd-MM-yyyy")), 406),
            line(6, F.lit("Valid Until"), 470),
            line(7, F.date_format("expiry_d", "dd.MM.yyyy"), 500),
            line(8, F.when(passport, zone1), 900),
            line(9, F.when(passport, zone2), 960)]
        return explode_present(whole, ["case_id", "document_id", "document_type", "confidence"], texts,
                               "text").select("*", F.lit(40).alias("x"), F.lit(600).alias("w"), F.lit(24).alias("h"))

    @cached_property
    def forensics(self) -> DataFrame:
        """Scores of image detectors per document."""
        score = F.bround((F.col("l_partkey") % 97) / 97.0, 2)
        kinds = F.array(*[F.lit(k) for k in ("copy_move_anomaly", "ela_compression_anomaly",
                                             "noise_gradient_anomaly", "metadata_tamper_indicator")])
        return self.docs.filter(F.col("l_quantity") <= 10).select(
            "case_id", "document_id", "file_name",
            F.when(F.col("l_suppkey") % 2 == 0, "photo zone").otherwise("text band").alias("region"),
            F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("finding_type"),
            score.alias("score"),
            F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low").alias("severity"))

    @cached_property
    def reviews(self) -> DataFrame:
        first = self.members.groupBy("case_id").agg(F.min("user_id").alias("assigned_to"))
        return self.cases.filter(F.col("status") == "under_review").join(first, "case_id").select(
            F.col("case_id").alias("review_id"), "case_id", "assigned_to",
            F.when(F.col("case_id") % 2 == 0, "pending").otherwise("approved").alias("status"),
            F.date_add("created_on", 30).alias("due_on"))

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("actor_id"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("segment"),
            F.col("event_type").alias("action"), F.col("props").alias("details"),
            F.col("ts").cast("timestamp").alias("created_at"))

    @cached_property
    def stages(self) -> DataFrame:
        return self.raw("events").select(
            F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("case_id"),
            F.col("event_id").alias("order_index"), F.col("event_type").alias("stage_key"),
            F.floor(F.col("value") * 10).cast("int").alias("duration_ms"))

    @cached_property
    def versions(self) -> DataFrame:
        """Text evidence: versions of a document share its source and language."""
        return self.texts.select(
            F.col("doc_id").alias("version_id"),
            F.concat_ws("/", "source", "lang", (F.col("doc_id") % 97).cast("string")).alias("document_id"),
            F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
            "lang", "source", "text", "n_chars", F.sha2("text", 256).alias("sha256"))

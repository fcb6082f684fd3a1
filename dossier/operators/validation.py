"""Checks of single documents: formats, dates, mandatory values, zones and codes."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier import policy
from dossier.functions.dates import age_at, iso_date, parse_date, short_date
from dossier.functions.shapes import check_digit
from dossier.functions.text import clean_number, names_match, present
from dossier.operators.listing import best_candidate, ordinals
from dossier.session import cut, explode_present, settle


WIDE_FIELDS = tuple(f for f in policy.FIELD_LABELS if f != "facial_photo") + ("surname_part",)


def by_document(docs: DataFrame, fields: DataFrame, names: Sequence[str] = WIDE_FIELDS) -> DataFrame:
    """One row per document with a column per field and the number of field rows.

    Of repeated rows the last (``field_id``) counts. The checks, rules and
    cross-checks all read this table, so the long form is turned and its dates
    are parsed (``born``, ``issued``, ``ends``) once.
    """
    def pick(name: str) -> Column:
        own = F.col("field_name") == name
        if "field_id" in fields.columns:
            return F.max_by(F.when(own, F.col("value")), F.when(own, F.col("field_id")))
        return F.max(F.when(own, F.col("value")))

    turned = fields.groupBy("document_id").agg(
        F.count("*").alias("n_fields"), *[pick(n).alias(n) for n in names])
    joined = docs.select("case_id", "document_id", "document_type", "file_name", "doc_ord").join(
        turned, "document_id", "left").fillna(0, ["n_fields"])
    return joined.select("*", *[parse_date(f).alias(d) for f, d in (
        ("date_of_birth", "born"), ("issue_date", "issued"), ("expiry_date", "ends"))])


def _check(kind: str, status: Column | str, message: Column) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(F.lit(kind).alias("check_type"), status.alias("status"), message.alias("message"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _explode_checks(df: DataFrame, keys: Sequence[str], checks: Sequence[Column]) -> DataFrame:
    return explode_present(df, keys, checks, made=True)


def lookup(col: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table as an expression."""
    out = F.lit(None)
    for key, value in table.items():
        out = F.when(col == key, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def validate_documents(wide: DataFrame, as_of: Column,
                       patterns: Mapping[str, str] = policy.NUMBER_PATTERNS,
                       mandatory: Mapping[str, Sequence[str]] = policy.MANDATORY_FIELDS) -> DataFrame:
    """Check rows (case_id, document_id, check_type, status, message) per document of ``by_document``."""
    kind = F.lower(F.replace(F.coalesce(present("document_type"), F.lit("other")), F.lit(" "), F.lit("_")))
    number = F.upper(F.trim(F.coalesce("document_number", F.lit(""))))
    has_pattern = kind.isin(*patterns)
    fits = lookup(kind, {k: number.rlike(p) for k, p in patterns.items()})
    spaced = F.replace(kind, F.lit("_"), F.lit(" "))
    born, issued, ends = iso_date("date_of_birth"), iso_date("issue_date"), iso_date("expiry_date")
    age = age_at(born, as_of)
    given = present("date_of_birth").isNotNull()

    recognised = (
        F.when(~kind.isin("other", "unknown"), _check(
            "Document type recognized", "pass", _say("Detected type: ", spaced, ".")))
        .when(kind == "unknown", _check("Document type recognized", "warning", F.lit(
            "Type is currently marked as unknown / unclassified. Manual verification or correction recommended.")))
        .otherwise(_check("Document type recognized", "warning",
                          F.lit("Type could not be confidently identified."))))
    format_name = "Document number format"
    number_format = (
        F.when((number == "") & has_pattern, _check(
            format_name, "fail", F.lit("Mandatory document number was not found.")))
        .when(number == "", F.lit(None))
        .when(has_pattern & fits, _check(
            format_name, "pass", _say("'", number, "' matches the expected ", kind, " pattern.")))
        .when(has_pattern, _check(
            format_name, "fail", _say("'", number, "' does not match the expected ", kind, " pattern.")))
        .otherwise(_check(format_name, "pass", _say(
            "Document number present ('", number, "'); no type-specific pattern defined."))))
    plausible = "Date of birth plausibility"
    birth = (
        F.when(given & born.isNull(), _check("Date of birth format", "fail", _say(
            "Could not parse date of birth '", F.col("date_of_birth"), "'.")))
        .when(born > as_of, _check(plausible, "fail", _say(
            "Date of birth ", born.cast("string"), " is in the future.")))
        .when(age > 120, _check(plausible, "fail", _say("Implied age ", age.cast("string"), " is implausible.")))
        .when(born.isNotNull(), _check("Date of birth", "pass", _say(
            "Date of birth ", born.cast("string"), " (age ", age.cast("string"), ")."))))
    order = (
        F.when(ends <= issued, _check("Issue/expiry logic", "fail", _say(
            "Expiry ", ends.cast("string"), " precedes issue date ", issued.cast("string"), ".")))
        .when(issued < born, _check("Issue/DOB logic", "fail", _say(
            "Issue date ", issued.cast("string"), " precedes date of birth."))))
    expiry = (
        F.when(ends < as_of, _check("Expiration status", "warning", _say(
            "Document expired on ", ends.cast("string"), ".")))
        .when(ends >= as_of, _check("Expiration status", "pass", _say("Valid until ", ends.cast("string"), "."))))
    lacking = lookup(kind, {
        k: F.concat_ws(", ", *[F.when(present(n).isNull(), n) for n in needed])
        for k, needed in mandatory.items() if needed})
    required = (
        F.when(lacking == "", _check("Mandatory fields", "pass", F.lit("All required fields are present.")))
        .when(lacking.isNotNull(), _check("Mandatory fields", "fail", _say(
            "Missing required field(s): ", lacking, "."))))
    return _explode_checks(wide, ["case_id", "document_id"],
                           [recognised, number_format, birth, order, expiry, required])


def zone_unavailable(docs: DataFrame, zones: DataFrame) -> DataFrame:
    """The row a passport gets when no machine-readable zone was found on it."""
    return docs.filter(F.lower("document_type") == "passport").join(
        zones.select("document_id"), "document_id", "left_anti").select(
        "case_id", "document_id", F.lit("MRZ check").alias("check_type"), F.lit("unavailable").alias("status"),
        F.lit("No machine-readable zone could be detected on this passport image.").alias("message"))


def missing_required(docs: DataFrame, fields: DataFrame,
                     mandatory: Mapping[str, Sequence[str]] = policy.MANDATORY_FIELDS) -> DataFrame:
    """(document_id, field_name) pairs a type requires and the document lacks."""
    kind = F.lower(F.replace(F.coalesce("document_type", F.lit("other")), F.lit(" "), F.lit("_")))
    needed = lookup(kind, {k: F.array(*[F.lit(n) for n in v]) for k, v in mandatory.items()})
    wanted = docs.select("case_id", "document_id", "document_type", F.explode(needed).alias("field_name"))
    asked = sorted({n for names in mandatory.values() for n in names})  # other fields cannot be missing
    held = fields.filter(F.col("field_name").isin(*asked) & (F.coalesce("value", F.lit("")) != "")).select("document_id", "field_name")
    return wanted.join(held, ["document_id", "field_name"], "left_anti")


def document_status(wide: DataFrame, validations: DataFrame) -> DataFrame:
    """valid, review_required or unable_to_verify per document (case_id, document_id, document_type, n_fields)."""
    tallies = validations.groupBy("document_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", "warning", "unavailable")])
    rows = wide.select("case_id", "document_id", "document_type", "n_fields").join(
        tallies, "document_id", "left").fillna(0, tallies.columns[1:])
    status = (
        F.when((F.col("n") > 0) & (F.col("n_unavailable") == F.col("n")), policy.UNABLE)
        .when((F.col("n_fields") == 0) & (F.col("n_pass") == 0), policy.UNABLE)
        .when(F.col("n_fail") + F.col("n_warning") > 0, "review_required").otherwise("valid"))
    return rows.select("case_id", "document_id", "document_type", "n_fields",
                       F.col("n_pass").alias("passed"), F.col("n_fail").alias("failed"),
                       F.col("n_warning").alias("warned"), status.alias("status"))


def completeness(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Extracted fields per document, and whether its case has any."""
    counted = fields.groupBy("document_id").agg(F.count("*").alias("n_fields"))
    rows = docs.select("case_id", "document_id").join(counted, "document_id", "left").fillna(0, ["n_fields"])
    return rows.groupBy("case_id").agg(
        F.count("*").alias("n_documents"), F.sum("n_fields").alias("n_fields"),
        F.bool_or(F.col("n_fields") > 0).alias("any_fields"))


# ---- machine-readable zones ----------------------------------------------------------

def _unfilled(col: Column) -> Column:
    text = F.trim(F.replace(col, F.lit("<"), F.lit(" ")))
    return F.trim(F.regexp_replace(text, r"(.)\1{2,}", "$1"))


def _zone(line1: Column, line2: Column, as_of: Column) -> Column:
    """Two 44-character lines as a struct with its five check results."""
    def at(start: int, end: int) -> Column:
        return F.substring(line2, start + 1, end - start)

    def check(payload: Column, position: int) -> Column:
        return F.coalesce(check_digit(payload) == at(position, position + 1), F.lit(False))

    names = F.substring(line1, 6, 39)
    surname = F.substring_index(names, "<<", 1)
    given = F.substring(names, F.length(surname) + 3, F.lit(44))
    checks = F.struct(
        check(at(0, 9), 9).alias("document_number"), check(at(13, 19), 19).alias("date_of_birth"),
        check(at(21, 27), 27).alias("expiry_date"), check(at(28, 42), 42).alias("personal_number"),
        check(F.concat(at(0, 10), at(13, 20), at(21, 43)), 43).alias("composite"))
    return F.struct(
        F.coalesce(present(_unfilled(F.substring(line1, 1, 2))), F.lit("P")).alias("doc_code"),
        _unfilled(F.substring(line1, 3, 3)).alias("issuing_state"),
        _unfilled(surname).alias("surname"), _unfilled(given).alias("given_names"),
        F.trim(F.replace(at(0, 9), F.lit("<"), F.lit(""))).alias("document_number"),
        _unfilled(at(10, 13)).alias("nationality"),
        short_date(at(13, 19), as_of, "dob").cast("string").alias("dob"), at(20, 21).alias("sex"),
        short_date(at(21, 27), as_of, "expiry").cast("string").alias("expiry"),
        F.trim(F.replace(at(28, 42), F.lit("<"), F.lit(" "))).alias("personal_number"),
        checks.alias("checks"))


def _passed(zone: Column) -> Column:
    names = ("document_number", "date_of_birth", "expiry_date", "personal_number", "composite")
    return sum((zone["checks"][n].cast("int") for n in names), F.lit(0))


PAIR_BLOCK = 1000  # candidate lines of a document that one task may get


def mrz_parse(lines: DataFrame, as_of: Column) -> DataFrame:
    """The machine-readable zone of each document from its text lines (document_id, line_no, text).

    Candidate lines pair with their next three; of the pairs the one with the
    best mix of length and passing digits wins. Letters that stand for digits
    are repaired where that lets more digits pass.
    """
    compact = F.upper(F.regexp_replace("text", r"\s+", ""))
    fillers = F.length("zone") - F.length(F.replace(F.col("zone"), F.lit("<"), F.lit("")))
    marked = lines.filter(F.contains("text", F.lit("<")))
    found = settle(marked.select("document_id", "line_no", "text"), "zone", compact).filter(
        (F.length("zone") >= 30) & (fillers >= 5) & F.col("zone").rlike("^[A-Z0-9<]+$"))
    # ranks take several passes: the few candidates are written, so that all lines are read once
    candidates = ordinals(cut(found), ["document_id"], "line_no").select("document_id", "ordinal", "zone")
    # a line meets its next three inside a block of lines; the first three of a block end the block before as well
    block = F.floor(F.col("ordinal") / PAIR_BLOCK)
    own = F.struct(block.alias("block"), F.lit(True).alias("opens"))
    before = F.when((F.col("ordinal") % PAIR_BLOCK < 3) & (block > 0), F.struct(
        (block - 1).alias("block"), F.lit(False).alias("opens")))
    placed = explode_present(candidates, ["document_id", "ordinal", "zone"], [own, before], "block")
    ahead = Window.partitionBy("document_id", "block").orderBy("ordinal")
    here = F.struct("ordinal", "zone")
    nexts = placed.withColumns({f"next{k}": F.lead(here, k).over(ahead) for k in (1, 2, 3)}).filter("opens")
    met = nexts.select("document_id", F.col("ordinal").alias("first_no"), F.col("zone").alias("zone1"),
                       F.explode(F.array("next1", "next2", "next3")).alias("_next")).filter(F.col("_next").isNotNull())
    fit = 1 - (F.abs(F.length("zone1") - 44) + F.abs(F.length("zone") - 44)) / 44
    pairs = met.select("document_id", "first_no", "zone1", "_next.*").withColumn("fit", fit).filter(F.col("fit") > 0.3)

    def whole(col: str) -> Column:
        return F.substring(F.rpad(F.col(col), 44, "<"), 1, 44)

    def repaired(col: Column) -> Column:
        return F.translate(col, "OISBZ", "01582")

    padded = pairs.select("document_id", "first_no", "ordinal", "fit", whole("zone1").alias("line1"),
                          whole("zone").alias("line2"))
    both = padded.withColumns({"fixed1": repaired(F.col("line1")), "fixed2": repaired(F.col("line2"))})
    read = settle(settle(both, "raw", _zone(F.col("line1"), F.col("line2"), as_of)),
                  "fixed", _zone(F.col("fixed1"), F.col("fixed2"), as_of))
    better = _passed(F.col("fixed")) > _passed(F.col("raw"))
    chosen = settle(read, "best", F.when(better, F.col("fixed")).otherwise(F.col("raw"))).select(
        "document_id", "first_no", "ordinal", "fit", F.col("best").alias("zone"))
    scored = settle(chosen, "passed", _passed(F.col("zone"))).filter(F.col("passed") > 0).withColumn(
        "score", F.col("fit") * 0.5 + F.col("passed") / 5 * 0.5).filter(F.col("score") > 0.55)
    best = best_candidate(scored, ["document_id"], "score", F.struct("first_no", "ordinal"), "passed", "zone")
    return best.select("document_id", "score", "passed", "zone.*")


_ZONE_CHECKS = ("document_number", "date_of_birth", "expiry_date", "personal_number", "composite")


def mrz_compare(zones: DataFrame, wide: DataFrame) -> DataFrame:
    """Zone against print: a checksum row and number, birth and name rows where both sides exist."""
    wide = zones.select("document_id", "checks", F.col("document_number").alias("zone_number"),
                        F.col("dob").alias("zone_dob"),
                        F.trim(F.concat_ws(" ", "given_names", "surname")).alias("zone_name")).join(
        wide.select("case_id", "document_id", "doc_ord", "document_number", "date_of_birth", "full_name"),
        "document_id")
    failed = F.concat_ws(", ", *[F.when(~F.col(f"checks.{c}"), c) for c in _ZONE_CHECKS])
    number, born, name = present("document_number"), present("date_of_birth"), present("full_name")

    def row(kind: str, ok: Column, otherwise: str, good: Column, bad: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("check_type"), F.when(ok, "pass").otherwise(otherwise).alias("status"),
                        F.when(ok, good).otherwise(bad).alias("message"), value.alias("coded"))

    checks = [
        row("MRZ checksum", failed == "", "fail", F.lit("All MRZ check digits are structurally valid."),
            _say("MRZ check digit failure(s): ", failed, "."), F.lit(None).cast("string")),
        F.when(number.isNotNull(), row(
            "MRZ vs printed document number", F.upper(F.trim(number)) == F.upper("zone_number"), "fail",
            _say("Document number matches MRZ (", F.col("zone_number"), ")."),
            _say("Mismatch: printed '", number, "' vs MRZ '", F.col("zone_number"), "'."), F.col("zone_number"))),
        F.when(born.isNotNull() & F.col("zone_dob").isNotNull(), row(
            "MRZ vs printed date of birth", born == F.col("zone_dob"), "fail",
            _say("Date of birth matches MRZ (", F.col("zone_dob"), ")."),
            _say("Mismatch: printed ", born, " vs MRZ ", F.col("zone_dob"), "."), F.col("zone_dob"))),
        F.when(name.isNotNull(), row(
            "MRZ vs printed name", names_match(name, F.col("zone_name")), "warning",
            _say("Name consistent with MRZ (", F.col("zone_name"), ")."),
            _say("Name differs from MRZ: printed '", name, "' vs MRZ '", F.col("zone_name"), "'."),
            F.col("zone_name")))]
    return _explode_checks(wide, ["case_id", "document_id", "doc_ord"], checks)


# ---- codes --------------------------------------------------------------------------

def parse_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Payloads that are JSON objects, as a map; all others are dropped."""
    parsed = F.from_json(F.col(col), "map<string,string>")
    return settle(df.filter(F.col(col).rlike(r"^\s*\{")), "object", parsed).filter(F.col("object").isNotNull())


def qr_compare(payloads: DataFrame, wide: DataFrame) -> DataFrame:
    """Codes (document_id, payload) against the print; one agreeing payload is enough."""
    key = F.col("object")
    read = parse_payload(payloads).select(
        "document_id", "payload",
        present(clean_number(F.try_element_at(key, F.lit("doc")))).alias("qr_number"),
        present(F.trim(F.upper(F.try_element_at(key, F.lit("name"))))).alias("qr_name"),
        present(F.trim(F.coalesce(present(F.try_element_at(key, F.lit("dob"))),
                                  F.try_element_at(key, F.lit("date_of_birth"))))).alias("qr_dob"))
    printed = wide.select(
        "case_id", "document_id", "doc_ord", F.col("born"), present(clean_number("document_number")).alias("number"),
        present("full_name").alias("name"), present("date_of_birth").alias("dob"))
    agrees = parse_date("qr_dob") == F.col("born")
    tallied = read.join(printed, "document_id").groupBy("document_id").agg(
        F.first("case_id").alias("case_id"), F.first("doc_ord").alias("doc_ord"),
        F.bool_or(F.col("qr_number") == F.col("number")).alias("number_ok"),
        F.bool_or(names_match("name", "qr_name")).alias("name_ok"),
        F.bool_or(agrees).alias("dob_ok"),
        F.count("qr_number").alias("n_number"), F.count("qr_name").alias("n_name"),
        F.count("qr_dob").alias("n_dob"),
        F.min_by("qr_number", F.when(F.col("qr_number").isNotNull(), F.col("payload"))).alias("qr_number"),
        F.min_by("qr_name", F.when(F.col("qr_name").isNotNull(), F.col("payload"))).alias("qr_name"),
        F.min_by("qr_dob", F.when(F.col("qr_dob").isNotNull(), F.col("payload"))).alias("qr_dob"),
        F.first("number").alias("number"), F.first("name").alias("name"), F.first("dob").alias("dob"))

    def row(kind: str, here: Column, ok: Column, otherwise: str, good: Column, bad: Column, value: str) -> Column:
        ok = F.coalesce(ok, F.lit(False))
        return F.when(here, F.struct(
            F.lit(kind).alias("check_type"), F.when(ok, "pass").otherwise(otherwise).alias("status"),
            F.when(ok, good).otherwise(bad).alias("message"), F.col(value).alias("coded")))

    checks = [
        row("QR payload vs document number", (F.col("n_number") > 0) & F.col("number").isNotNull(),
            F.col("number_ok"), "fail",
            _say("QR-encoded document number matches the printed value (", F.col("number"), ")."),
            _say("QR/document mismatch: QR encodes ", F.col("qr_number"), " but the printed number reads ",
                 F.col("number"), "."), "qr_number"),
        row("QR payload vs name", (F.col("n_name") > 0) & F.col("name").isNotNull(), F.col("name_ok"), "warning",
            F.lit("Name on QR payload is consistent with the printed name."),
            _say("QR name ", F.col("qr_name"), " differs from printed '", F.col("name"), "'."), "qr_name"),
        row("QR payload vs date of birth", (F.col("n_dob") > 0) & F.col("dob").isNotNull(), F.col("dob_ok"), "fail",
            _say("Date of Birth on QR payload matches printed DOB (", F.col("dob"), ")."),
            _say("QR/DOB mismatch: QR encodes ", F.col("qr_dob"), " but printed reads '", F.col("dob"), "'."),
            "qr_dob")]
    return _explode_checks(tallied, ["case_id", "document_id", "doc_ord"], checks)

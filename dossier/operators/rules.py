"""Rules over all documents of a case."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dossier import policy
from dossier.functions.dates import age_at
from dossier.functions.text import names_match, normalize_name, ratio, string_similarity, title_code
from dossier.session import cut, explode_present


def _kind() -> Column:
    return F.lower(F.trim(F.coalesce("document_type", F.lit(""))))


def _row(df: DataFrame, rule: str, status: Column, severity: Column, text: Column) -> DataFrame:
    return df.select("case_id", F.lit(rule).alias("rule_id"), status.alias("status"), severity.alias("severity"),
                     text.alias("explanation"))


def rule_age(wide: DataFrame, least_age: int = 18) -> DataFrame:
    """Licences and voter cards issued before the age of 18, by the first birth date of the case."""
    wide = wide.select(
        "case_id", "document_id", "file_name", "doc_ord", _kind().alias("kind"), "born", "date_of_birth", "issued")
    births = cut(wide.groupBy("case_id").agg(F.min_by(
        "born", F.when(F.coalesce("date_of_birth", F.lit("")) != "", F.struct("doc_ord", "document_id")))
        .alias("born")))
    bound = wide.filter(F.col("kind").isin(*policy.AGE_BOUND_TYPES) & F.col("issued").isNotNull()).drop("born")
    early = bound.join(births.filter(F.col("born").isNotNull()), "case_id").withColumn(
        "age", age_at(F.col("born"), F.col("issued"))).filter(F.col("age") < least_age).groupBy("case_id").agg(
        F.min(F.struct("doc_ord", "document_id", "age", "file_name", "kind")).alias("v"))
    judged = births.join(early, "case_id", "left")
    bad, unknown = F.col("v").isNotNull(), F.col("born").isNull()
    text = (
        F.when(unknown, "No Date of Birth available across submitted documents to verify age eligibility.")
        .when(bad, F.concat(F.lit("Applicant was only "), F.col("v.age").cast("string"),
                            F.lit(" years old at the issuance of "), F.col("v.file_name"), F.lit(" ("),
                            title_code(F.col("v.kind")),
                            F.lit("), violating statutory minimum age requirement (18+).")))
        .otherwise("Applicant age at issuance meets or exceeds regulatory minimum requirements (18+)."))
    return _row(judged, "RULE-AGE-001",
                F.when(unknown, "not_applicable").when(bad, "fail").otherwise("pass"),
                F.when(bad, "high").otherwise("info"), text)


def date_issues(wide: DataFrame, as_of: Column) -> DataFrame:
    """One row per date out of order: births or issues in the future, expiry not after issue."""

    def issue(when: Column, number: int, *parts: Column | str) -> Column:
        text = F.concat("file_name", F.lit(": "), *[F.lit(p) if isinstance(p, str) else p.cast("string")
                                                    for p in parts])
        return F.when(when, F.struct(F.lit(number).alias("issue_no"), text.alias("issue")))

    born, issued, ends = F.col("born"), F.col("issued"), F.col("ends")
    rows = [
        issue(born > as_of, 1, "Date of birth (", born, ") is in the future."),
        issue(issued > as_of, 2, "Issue date (", issued, ") is in the future."),
        issue(ends <= issued, 3, "Expiration date (", ends, ") precedes or equals issue date (", issued, ").")]
    return explode_present(wide, ["case_id", "document_id", "doc_ord"], rows)


def rule_dates(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Verdict per case; names the first issue and counts the rest, which ``date_issues`` lists in full."""
    worst = issues.groupBy("case_id").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_ord", "document_id", "issue_no", "issue")).alias("first"))
    judged = docs.select("case_id").distinct().join(worst, "case_id", "left")
    bad, more = F.col("n") > 0, F.col("n") - 1
    text = F.when(bad, F.concat(
        F.lit("Chronological inconsistencies detected: "), F.col("first.issue"),
        F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))) \
        .otherwise("All dates (birth, issuance, expiration) conform to a valid chronological sequence.")
    return _row(judged, "RULE-CHRONO-001", F.when(bad, "fail").otherwise("pass"),
                F.when(bad, "high").otherwise("info"), text)


def rule_pan(wide: DataFrame) -> DataFrame:
    """Fifth character of the first tax number against the initial of the first surname."""
    wide = wide.withColumn("kind", _kind())
    number, pos = F.col("document_number"), F.struct("doc_ord", "document_id")
    tax = ((F.col("kind") == "pan") | number.rlike("^[A-Za-z]{5}[0-9]{4}[A-Za-z]$")) & (F.length(number) == 10)
    words = F.split(F.regexp_replace(F.trim("full_name"), r"\s+", " "), " ")
    part = F.upper(F.trim("surname_part"))
    surname = F.when(F.coalesce("surname_part", F.lit("")) != "", part).when(
        F.size(words) > 1, F.upper(F.element_at(words, -1)))
    judged = wide.groupBy("case_id").agg(
        F.min_by(F.upper(number), F.when(tax, pos)).alias("pan"),
        F.min_by(surname, F.when(surname.isNotNull(), pos)).alias("surname"))
    kind, expected = F.substring("pan", 4, 1), F.substring("pan", 5, 1)
    initial = F.substring("surname", 1, 1)
    none, other = F.col("pan").isNull(), kind.isin(*policy.NON_PERSON_PAN)
    lost, same = F.col("surname").isNull(), initial == expected
    status = (F.when(none | other, "not_applicable").when(lost, "warning").when(same, "pass").otherwise("fail"))
    severity = F.when(none | other | ~lost & same, "info").when(lost, "low").otherwise("high")
    text = (
        F.when(none, "No PAN card available to evaluate 5th-character surname checksum.")
        .when(other, F.format_string(
            "PAN entity type indicator is '%s' (non-individual entity); surname check omitted.", kind))
        .when(lost, F.format_string(
            "PAN is %s (expected surname initial '%s'), but no distinct surname could be parsed.", "pan", expected))
        .when(same, F.format_string(
            "PAN 5th character '%s' matches the first letter of surname '%s'.", expected, "surname"))
        .otherwise(F.format_string(
            "PAN 5th character '%s' does not match applicant surname '%s' (expected initial '%s', but found '%s').",
            expected, "surname", expected, initial)))
    return _row(judged, "RULE-PAN-001", status, severity, text)


def rule_parent(wide: DataFrame, field_name: str = "father_name", least: float = 0.75) -> DataFrame:
    """Every parent name against the first: no match and little likeness is a conflict."""
    own = wide.filter(F.coalesce(field_name, F.lit("")) != "").withColumn("value", F.col(field_name))
    pos = F.struct("doc_ord", "document_id")
    heads = own.groupBy("case_id").agg(F.count("*").alias("n"), F.min(F.struct(pos.alias("pos"), "value", "file_name"))
                                       .alias("ref"))
    # likeness is measured once per distinct spelling, and only where tokens do not match
    spelled = own.groupBy("case_id", "value").agg(F.min(F.struct(pos.alias("pos"), "file_name")).alias("at"))
    against = spelled.join(heads.filter(F.col("n") > 1), "case_id").filter(
        ~names_match("ref.value", "value"))
    unlike = against.withColumn("likeness", string_similarity(F.col("ref.value"), F.col("value"))).filter(
        F.col("likeness") < least)
    worst = unlike.groupBy("case_id").agg(F.min(F.struct("at", "value")).alias("bad"))
    judged = wide.select("case_id").distinct().join(heads, "case_id", "left").join(worst, "case_id", "left")
    few, bad = F.coalesce(F.col("n"), F.lit(0)) < 2, F.col("bad").isNotNull()
    text = (
        F.when(few, "Fewer than two documents contain Father/Guardian name fields.")
        .when(bad, F.format_string(
            "Parental name discrepancy detected across documents: %s ('%s') vs %s ('%s').",
            "bad.at.file_name", "bad.value", "ref.file_name", "ref.value"))
        .otherwise(F.format_string(
            "Parental/Guardian name '%s' is consistent across all %d reporting documents.", "ref.value", "n")))
    return _row(judged, "RULE-FATHER-001", F.when(few, "not_applicable").when(bad, "fail").otherwise("pass"),
                F.when(~few & bad, "high").otherwise("info"), text)


def rule_findings(*results: DataFrame) -> DataFrame:
    """Failed and warning rules in the shape of consistency findings."""
    rows = results[0]
    for more in results[1:]:
        rows = rows.unionByName(more)
    return rows.filter(F.col("status").isin("fail", "warning")).select(
        "case_id", F.col("rule_id").alias("field_name"), F.lit("").alias("type_key"), "severity",
        F.lit(0).cast("long").alias("n_documents"), F.lit(0).cast("long").alias("n_clusters"), "explanation")


# ---- likeness of all names of a case ------------------------------------------------

_TILE = 64


def name_similarity(fields: DataFrame, field_name: str = "full_name") -> DataFrame:
    """Mean likeness over all pairs of documents with a name; 1.0 below two.

    Spellings are counted first, in tiles of bounded arrays; only tile pairs
    travel, never value pairs, and an ordinary case is one tile. Equal
    spellings contribute their pairs by count.
    """
    own = fields.filter((F.col("field_name") == field_name) & (F.coalesce("value", F.lit("")) != ""))
    spelled = own.groupBy("case_id", normalize_name("value").alias("name")).agg(F.count("*").alias("n"))
    spelled = cut(spelled)
    sizes = spelled.groupBy("case_id").agg(F.sum("n").alias("n_names"), F.count("*").alias("n_spellings"))
    tile = F.pmod(F.xxhash64("name"), F.ceil(F.col("n_spellings") / _TILE)).cast("int")
    tiles = spelled.join(sizes, "case_id").groupBy("case_id", tile.alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct("name", "n"))).alias("items"))
    right = tiles.select("case_id", F.col("tile").alias("tile_b"), F.col("items").alias("items_b"))
    met = tiles.join(right, "case_id").filter(F.col("tile") <= F.col("tile_b"))
    summed = met.select("case_id", _tile_likeness(
        F.to_json("items"), F.when(F.col("tile") < F.col("tile_b"), F.to_json("items_b"))).alias("s")) \
        .groupBy("case_id").agg(F.sum("s").alias("s"))
    pairs = F.col("n_names") * (F.col("n_names") - 1) / 2
    return sizes.join(summed, "case_id").select(
        "case_id", "n_names", "n_spellings",
        F.when(F.col("n_names") < 2, 1.0).otherwise(F.bround(F.col("s") / pairs, 2)).alias("overall_similarity"))


@F.pandas_udf(T.DoubleType())
def _tile_likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Weighted sum of likeness within one tile, or between two."""
    sums = []
    for a, b in zip(left, right):
        first = [(i["name"], i["n"]) for i in json.loads(a)]
        total = 0.0
        if b is None:
            for i, (x, n) in enumerate(first):
                total += n * (n - 1) / 2 * (1.0 if x else 0.0)
                total += sum(n * m * ratio(x, y) for y, m in first[i + 1:])
        else:
            second = [(i["name"], i["n"]) for i in json.loads(b)]
            # the smaller spelling stays on the left, as within a tile
            total = sum(n * m * ratio(min(x, y), max(x, y)) for x, n in first for y, m in second)
        sums.append(total)
    return pd.Series(sums, dtype="float64")

"""Evidence of a case fused into a ledger of weighted factors and a score."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier import policy
from dossier.operators.analytics import counts_for
from dossier.session import explode_present

_FLAGS = ("forensic_high", "forensic_medium", "validation_fail", "expired", "mrz_fail", "mrz_pass", "reuse_hits")


def case_evidence(cases: DataFrame, docs: DataFrame, findings: DataFrame, forensics: DataFrame,
                  validations: DataFrame, wide: DataFrame) -> DataFrame:
    """One row of counts and flags per case; ``wide`` gives the field rows of each document.

    All sources are mapped to one narrow shape and aggregated in a single pass by
    case, so the case key is shuffled once and partially summed before.
    """
    zero = F.lit(0).cast("long")
    conflict = F.col("severity").isin("medium", "high")
    kinds = sorted(set(policy.CONFLICT_FACTOR.values()))
    measures = [*kinds, *_FLAGS, "name_info", "address_info", "face_info", "checks", "checks_ok", "n_fields",
                "n_read", "n_docs"]

    def shaped(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("case_id", *[values[m].cast("long").alias(m) if m in values else zero.alias(m)
                                      for m in measures])

    def one(when: Column) -> Column:
        return F.coalesce(when, F.lit(False)).cast("long")

    weight = counts_for(findings)
    by_kind = {}
    for kind in kinds:
        names = [f for f, k in policy.CONFLICT_FACTOR.items() if k == kind]
        by_kind[kind] = F.when(conflict & F.col("field_name").isin(*names), weight).otherwise(zero)
    info = F.col("severity") == "info"
    check, status = F.col("check_type"), F.col("status")
    sources = [
        shaped(findings, **by_kind, name_info=one(info & (F.col("field_name") == "full_name")),
               address_info=one(info & (F.col("field_name") == "address")),
               face_info=one(info & (F.col("field_name") == "facial_photo"))),
        shaped(forensics, forensic_high=one(F.col("severity") == "high"),
               forensic_medium=one(F.col("severity") == "medium")),
        shaped(validations, validation_fail=one(status == "fail"),
               expired=one((check == "Expiration status") & (status == "warning")),
               mrz_fail=one((check == "MRZ checksum") & (status == "fail")),
               mrz_pass=one((check == "MRZ checksum") & (status == "pass")),
               reuse_hits=one(check == "Duplicate / reuse"), checks=F.lit(1),
               checks_ok=one(status.isin("pass", "unavailable"))),
        shaped(wide, n_fields=F.col("n_fields")),
        shaped(docs, n_docs=F.lit(1), n_read=one(F.col("ocr_mean_confidence").isNotNull())
               if "ocr_mean_confidence" in docs.columns else zero),
        shaped(cases)]
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("case_id").agg(*[F.sum(m).alias(m) for m in measures])


_WORDS = {
    "dob_mismatch": "Cross-document conflict detected in date of birth.",
    "name_mismatch": "Cross-document conflict detected in full name.",
    "document_number_mismatch": "Cross-document conflict detected in document number.",
    "address_mismatch": "Cross-document conflict detected in address.",
    "gender_nationality_mismatch": "Cross-document conflict detected in gender or nationality.",
    "face_mismatch": "Cross-document conflict detected in facial photo.",
    "forensic_high": "High-suspicion visual tampering indicator(s).",
    "forensic_medium": "Visual tampering indicator(s) detected.",
    "validation_fail_per_check": "Structural/logical validation check(s) failed.",
    "expired_document": "At least one submitted document is expired.",
    "mrz_checksum_fail": "MRZ checksum verification failed.",
    "document_reuse": "This identity evidence was reused across submissions",
    "name_consistent": "Name consistent across documents.",
    "address_consistent": "Address consistent across documents.",
    "face_matched": "Facial photo consistent across documents.",
    "mrz_valid": "MRZ checksums verified successfully.",
    "all_validations_pass": "All document validation checks passed.",
}


def risk_ledger(evidence: DataFrame, weights: Mapping[str, tuple[int, int | None]] = policy.RISK_WEIGHTS,
                reductions: Mapping[str, int] = policy.RISK_REDUCTIONS) -> DataFrame:
    """Factor rows (case_id, factor, occurrences, applied, score, direction, explanation).

    Conflict factors stand once per conflicting field in total; reductions apply
    only where no conflict, strong tampering sign or reuse is present.
    """
    conflicts = sorted(set(policy.CONFLICT_FACTOR.values()))
    gated = sum((F.col(k) for k in conflicts), F.lit(0)) + F.col("forensic_high") + F.col("reuse_hits") > 0
    applications = {
        **{k: F.col(k) for k in conflicts},
        "forensic_high": F.col("forensic_high"), "forensic_medium": F.col("forensic_medium"),
        "validation_fail_per_check": F.col("validation_fail"),
        "expired_document": (F.col("expired") > 0).cast("long"),
        "mrz_checksum_fail": (F.col("mrz_fail") > 0).cast("long"),
        "document_reuse": (F.col("reuse_hits") > 0).cast("long"),
    }
    holds = {
        "name_consistent": F.col("name_info") > 0, "address_consistent": F.col("address_info") > 0,
        "face_matched": F.col("face_info") > 0, "mrz_valid": F.col("mrz_pass") > 0,
        "all_validations_pass": (F.col("checks") > 0) & (F.col("checks_ok") == F.col("checks")),
    }

    def row(factor: str, n: Column, cap: int | None, weight: int, direction: str) -> Column:
        used = F.least(n, F.lit(cap)) if cap else n
        detail = (F.when(n > used, F.concat(F.lit(" ("), n.cast("string"), F.lit(" occurrences, capped at "),
                                            used.cast("string"), F.lit(")")))
                  .when(used > 1, F.concat(F.lit(" ("), used.cast("string"), F.lit(" occurrences)"))).otherwise(""))
        if factor == "document_reuse":  # applied once, and says how many matches stand behind it
            detail = F.concat(F.lit(" ("), F.col("reuse_hits").cast("string"), F.lit(" match(es) found)."))
        return F.when(n > 0, F.struct(
            F.lit(factor).alias("factor"), n.cast("long").alias("occurrences"), used.cast("long").alias("applied"),
            (used * weight).cast("long").alias("score"), F.lit(direction).alias("direction"),
            F.concat(F.lit(_WORDS[factor]), detail).alias("explanation")))

    rows = [row(f, n, weights[f][1], weights[f][0], "increase") for f, n in applications.items()]
    rows += [row(f, (ok & ~gated).cast("long"), None, reductions[f], "decrease") for f, ok in holds.items()]
    return explode_present(evidence, ["case_id"], rows)


def capped_sum(df: DataFrame, keys: Sequence[str], weight: str, n: str, cap: str) -> DataFrame:
    """Sum of weight × occurrences, each held at its cap; a null cap holds nothing."""
    used = F.coalesce(F.least(F.col(n), F.col(cap)), F.col(n))
    return df.groupBy(*keys).agg(F.sum(used * F.col(weight)).alias("total"))


def band_of(score: Column, bands: Sequence[tuple[int, str, str]] = policy.RISK_BANDS) -> Column:
    """(band, recommendation) of a score; the first band whose upper end holds it."""
    ordered = sorted(bands)
    def pair(b: tuple[int, str, str]) -> Column:
        return F.struct(F.lit(b[1]).alias("band"), F.lit(b[2]).alias("recommendation"))

    out = pair(ordered[-1])
    for band in reversed(ordered):
        out = F.when(score <= band[0], pair(band)).otherwise(out)
    return out


def risk_score(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """Score 0 to 100, band and recommendation of every case; no evidence at all means unable to verify."""
    totals = ledger.groupBy("case_id").agg(F.sum("score").alias("total"), F.count("*").alias("n_factors"))
    rows = evidence.select("case_id", (F.col("n_fields") + F.col("n_read") > 0).alias("any_evidence")).join(
        totals, "case_id", "left").select(
        "case_id", "any_evidence", F.coalesce("n_factors", F.lit(0)).alias("n_factors"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("total", F.lit(0)))).alias("score"))
    banded = rows.withColumn("_b", band_of(F.col("score")))
    return banded.select(
        "case_id", "score", "n_factors", F.col("_b.band").alias("band"),
        F.when(F.col("any_evidence"), F.col("_b.recommendation")).otherwise(policy.UNABLE).alias("recommendation"))


def ledger_order(ledger: DataFrame) -> DataFrame:
    """Factors with their rank in the case; a case has at most one row per factor, so ranks are bounded."""
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "factor")
    return ledger.withColumn("position", F.row_number().over(order))

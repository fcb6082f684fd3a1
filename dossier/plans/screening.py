"""The screening of all cases at once, as a graph of DataFrames.

Checks, reuse and consistency do not depend on each other; only the score waits
for all of them. Tables that several steps read are written once.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from dossier.operators import agreement, fusion, report, reuse, risk, rules, validation
from dossier.session import cut, cut_by

_CHECKS = ["case_id", "document_id", "check_type", "status", "message"]


class Screening:
    """Lazily built results over documents, fields, image findings, code payloads, text lines and photo findings.

    ``faces`` (case_id, severity, pairs) are the outcomes of the vector comparison (``reuse.face_findings``).
    ``by_document`` are documents and fields once more, dealt by ``document_id`` where the caller can do that cheaply, in
    ``document_parts`` parts; ``payloads`` may be dealt likewise. ``fields`` may be dealt by ``case_id``, and ``together``
    says that they are and that no case is too large for one task.
    """

    def __init__(self, cases: DataFrame, docs: DataFrame, fields: DataFrame, as_of: Column,
                 forensics: DataFrame | None = None, payloads: DataFrame | None = None,
                 lines: DataFrame | None = None, faces: DataFrame | None = None,
                 by_document: tuple[DataFrame, DataFrame] | None = None, document_parts: int | None = None,
                 together: bool = False):
        spark = cases.sparkSession
        self.cases, self.docs, self.fields, self.as_of = cases, docs, fields, as_of
        self.forensics = forensics if forensics is not None else spark.createDataFrame(
            [], "case_id bigint, document_id string, file_name string, region string, finding_type string, "
                "score double, severity string")
        self.payloads, self.lines, self.faces = payloads, lines, faces
        self.by_document = by_document or (docs, fields)
        self.document_parts, self.together = document_parts, together

    @cached_property
    def wide(self) -> DataFrame:
        """Documents with a column per field: read by checks, rules and cross-checks, so written once."""
        rows = validation.by_document(*self.by_document)
        return cut_by(rows, "document_id", self.document_parts) if self.document_parts else cut(rows)

    @cached_property
    def clustered(self) -> list[DataFrame]:
        return agreement.cluster_parts(agreement.field_values(self.fields), together=self.together)

    @cached_property
    def zones(self) -> DataFrame | None:
        return None if self.lines is None else cut(validation.mrz_parse(self.lines, self.as_of))

    @cached_property
    def coded_checks(self) -> DataFrame | None:
        """Rows of code and zone cross-checks, with the value the code held."""
        parts = []
        if self.payloads is not None:
            parts.append(validation.qr_compare(self.payloads, self.wide))
        if self.zones is not None:
            parts.append(validation.mrz_compare(self.zones, self.wide))
        if not parts:
            return None
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    @cached_property
    def validations(self) -> DataFrame:
        rows = validation.validate_documents(self.wide, self.as_of).select(*_CHECKS)
        if self.coded_checks is not None:
            rows = rows.unionByName(self.coded_checks.select(*_CHECKS))
        if self.zones is not None:
            rows = rows.unionByName(validation.zone_unavailable(self.docs, self.zones).select(*_CHECKS))
        if "file_hash" in self.docs.columns:
            rows = rows.unionByName(reuse.reuse_rows(reuse.same_hash(
                self.docs.select("document_id", "case_id", "file_hash"))).select(*_CHECKS))
        return rows

    @cached_property
    def rule_results(self) -> DataFrame:
        parts = [
            rules.rule_pan(self.wide), rules.rule_age(self.wide),
            rules.rule_dates(self.wide, rules.date_issues(self.wide, self.as_of)), rules.rule_parent(self.wide)]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return rows

    @cached_property
    def face_rows(self) -> DataFrame:
        """Photo findings of the cases in the shape of consistency findings."""
        if self.faces is None:
            empty = "case_id bigint, severity string, pairs bigint"
            return reuse.face_rows(self.cases.sparkSession.createDataFrame([], empty))
        return reuse.face_rows(self.faces.join(self.cases.select("case_id"), "case_id", "left_semi"))

    @cached_property
    def findings(self) -> DataFrame:
        """Conflicts and agreements of fields, failed rules and photo findings; ``pairs`` is what a row counts for."""
        rows = agreement.consistency(*self.clustered).unionByName(rules.rule_findings(self.rule_results))
        return rows.withColumn("pairs", F.lit(1).cast("long")).unionByName(self.face_rows)

    @cached_property
    def findings_table(self) -> DataFrame:
        """Findings written out, for readers that pass over them more than once."""
        return cut(self.findings)

    @cached_property
    def validations_table(self) -> DataFrame:
        return cut(self.validations)

    @cached_property
    def failed_table(self) -> DataFrame:
        """Failed checks written out, for readers that look at no others."""
        return cut(self.validations.filter(F.col("status") == "fail"))

    @cached_property
    def statuses(self) -> DataFrame:
        return validation.document_status(self.wide, self.validations)

    @cached_property
    def evidence(self) -> DataFrame:
        return risk.case_evidence(self.cases, self.docs, self.findings, self.forensics, self.validations, self.wide)

    @cached_property
    def ledger(self) -> DataFrame:
        return risk.risk_ledger(self.evidence)

    @cached_property
    def scores(self) -> DataFrame:
        """The score needs counts and ledger of the same cases; the counts are written once for both."""
        evidence = cut(self.evidence)
        return risk.risk_score(evidence, risk.risk_ledger(evidence))

    @cached_property
    def fused(self) -> DataFrame:
        coded = self.coded_checks
        if coded is None:
            none = self.fields.select("case_id", "document_id", "doc_ord", "field_name", F.lit("qr").alias("source"),
                                      "value").limit(0)
            return fusion.fusion(self.fields, none)
        return fusion.fusion(self.fields, cut(fusion.coded_values(coded)))  # names and the other fields read them apart

    @cached_property
    def report_modules(self) -> DataFrame:
        return report.module_rollup(self.docs, self.findings, self.forensics, self.validations)

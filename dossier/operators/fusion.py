"""Printed text, codes, machine-readable zones and documents voting on one value per field."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossier import policy
from dossier.functions.text import title_code
from dossier.operators.agreement import canonical, cluster_parts, forms_agree
from dossier.operators.listing import document_label, label_of

_KEYS = ["case_id", "field_name"]


def source_values(fields: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct values per (case, field) with the number of sources behind each.

    ``others``: case_id, field_name, source (qr or mrz), value. The first document
    also stands for the printed text, so its value counts once more where several
    documents vote.
    """
    wanted = F.col("field_name").isin(*policy.FUSED_FIELDS)
    field = F.col("field_name")
    printed = fields.filter(wanted & (F.trim(F.coalesce("value", F.lit(""))) != "")).select(
        *_KEYS, F.trim("value").alias("value"), canonical(field, F.trim("value")).alias("form"),
        F.struct(F.lit(3).alias("rank"), "doc_ord", "document_id",
                 F.concat("file_name", F.lit(" ("), "document_type", F.lit(")")).alias("source")).alias("pos"),
        F.lit(1).alias("w"))
    heads = printed.groupBy(*_KEYS).agg(
        F.min(F.struct("pos", "value", "form")).alias("h"), F.count("*").alias("docs"))
    text = heads.select(
        *_KEYS, F.col("h.value").alias("value"), F.col("h.form").alias("form"),
        F.struct(F.lit(0).alias("rank"), F.col("h.pos.doc_ord").alias("doc_ord"),
                 F.col("h.pos.document_id").alias("document_id"), F.lit("Printed OCR").alias("source")).alias("pos"),
        # with a single document the text is the only source, so the document row below weighs nothing more
        F.when(F.col("docs") > 1, 1).otherwise(0).alias("w"))
    first = F.col("source") == "qr"
    coded = others.filter(wanted & (F.coalesce("value", F.lit("")) != "")).groupBy(*_KEYS, "source").agg(
        F.min_by("value", F.struct("doc_ord", "document_id")).alias("value")).select(
        *_KEYS, "value", canonical(field, F.col("value")).alias("form"),
        F.struct(F.when(first, 1).otherwise(2).alias("rank"), F.lit(0).alias("doc_ord"),
                 F.lit("").alias("document_id"),
                 F.when(first, "Digital QR").otherwise("Passport MRZ").alias("source")).alias("pos"),
        F.lit(1).alias("w"))
    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEYS, "form").agg(F.sum("w").alias("n"), F.min(F.struct("pos", "value")).alias("first"))

    # print is counted before the codes come in: where a case is in one task, copies of a value do not move
    parts = counted(printed.unionByName(text)).unionByName(counted(coded))
    return parts.groupBy(*_KEYS, "form").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def fusion(fields: DataFrame, others: DataFrame) -> DataFrame:
    """Consensus per case and field with agreement status and caution."""
    wanted = F.col("field_name").isin(*policy.FUSED_FIELDS)
    seen = fields.filter(wanted & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    texts = seen.groupBy(*_KEYS).agg(
        F.min_by(F.trim("value"), F.struct("doc_ord", "document_id")).alias("ocr_value"),
        F.bround(F.avg(F.coalesce("confidence", F.lit(85.0))), 1).alias("ocr_confidence"),
        F.count("*").alias("n_documents"))
    plain, fuzzy = cluster_parts(source_values(fields, others), _KEYS)
    # values that agree with nothing stand alone, document by document
    alone = F.col("leader").isNull()
    sized = fuzzy.groupBy(*_KEYS, F.coalesce("leader.form", F.lit("")).alias("lead")).agg(
        F.sum("n").alias("size"), F.min("first").alias("lead_first"), F.bool_or(alone).alias("alone")).drop("lead")
    # outside names and addresses each value is a cluster already
    sized = sized.unionByName(plain.select(
        *_KEYS, F.col("n").alias("size"), F.col("first").alias("lead_first"), F.lit(False).alias("alone")))
    order = F.struct((-F.when(F.col("alone"), 1).otherwise(F.col("size"))).alias("neg"), "lead_first")
    tallied = sized.groupBy(*_KEYS).agg(
        F.sum("size").alias("n_sources"),
        F.sum(F.when(F.col("alone"), F.col("size")).otherwise(1)).alias("n_clusters"),
        F.min(order).alias("largest"), F.max(order).alias("last"))
    rows = tallied.join(texts, _KEYS, "left")
    top = -F.col("largest.neg")
    status = (
        F.when(F.col("n_sources") <= 1, "single_source").when(F.col("n_clusters") == 1, "unanimous")
        .when((top >= 2) & (F.col("n_clusters") == 2) & (F.col("n_sources") - top == 1), "majority_conflict")
        .otherwise("mismatch"))
    weak = (F.col("ocr_confidence") < 70) & (F.col("agreement_status") != "unanimous")
    consensus, outlier = F.col("largest.lead_first.value"), F.col("last.lead_first")
    summary = (
        F.when(F.col("agreement_status") == "single_source", "Single source available for verification.")
        .when(F.col("agreement_status") == "unanimous", F.format_string(
            "All %d sources agree unanimously (%s).", "n_sources", consensus))
        .when(F.col("agreement_status") == "majority_conflict", F.format_string(
            "%d sources agree ('%s'), 1 differs (%s: '%s'). Potential tampering in %s.",
            top, consensus, outlier["pos"]["source"], outlier["value"], outlier["pos"]["source"]))
        .otherwise(F.format_string("Multiple conflicting sources: %d values from %d sources.",
                                   "n_clusters", "n_sources")))
    return rows.withColumn("agreement_status", status).select(
        *_KEYS, label_of("field_name", policy.FIELD_LABELS).alias("label"), "ocr_value", "ocr_confidence",
        consensus.alias("consensus_value"), "n_sources", "n_clusters", "agreement_status",
        F.concat(summary, F.when(weak, " (Caution: Low OCR confidence detected).").otherwise(""))
        .alias("conflict_summary"),
        F.when(weak, "high").when(F.col("agreement_status") == "majority_conflict", "elevated")
        .when(F.col("agreement_status") == "mismatch", "high").otherwise("normal").alias("caution_level"))


def coded_values(checks: DataFrame) -> DataFrame:
    """Code and zone values out of cross-check rows (case_id, document_id, doc_ord, check_type, coded)."""
    kind = F.lower("check_type")
    field = (F.when(kind.contains("document number"), "document_number")
             .when(kind.contains("date of birth"), "date_of_birth").when(kind.contains("name"), "full_name"))
    source = F.when(kind.startswith("qr payload"), "qr").when(kind.startswith("mrz vs"), "mrz")
    return checks.select("case_id", "document_id", "doc_ord", field.alias("field_name"), source.alias("source"),
                         F.col("coded").alias("value")).dropna(subset=["field_name", "source", "value"])


def graph_nodes(cases: DataFrame, docs: DataFrame, fused: DataFrame) -> DataFrame:
    """Person, document and field nodes of every case that has documents."""
    risk = F.coalesce("overall_risk", F.lit(0))
    names = fused.filter(F.col("field_name") == "full_name").select("case_id", F.col("consensus_value").alias("who"))
    people = cases.join(docs.select("case_id").distinct(), "case_id", "left_semi").join(names, "case_id", "left")
    person = people.select(
        "case_id", F.lit("person-root").alias("node_id"), F.lit("person").alias("node_type"),
        F.coalesce("who", F.lit("Identity Subject")).alias("label"),
        F.when(risk >= 60, "mismatch").when(risk >= 30, "warning").otherwise("verified").alias("status"),
        (100 - risk).cast("double").alias("confidence"))
    papers = docs.select(
        "case_id", F.concat(F.lit("doc-"), "document_id").alias("node_id"), F.lit("document").alias("node_type"),
        title_code(F.coalesce("document_type", F.lit("Document"))).alias("label"),
        F.when(F.col("processing_status").isin("done", "completed"), "verified").otherwise("warning").alias("status"),
        F.coalesce(F.bround(F.col("type_confidence") * 100, 0), F.lit(90.0)).alias("confidence"))
    state = F.col("agreement_status")
    values = fused.filter(F.coalesce("consensus_value", F.lit("")) != "").select(
        "case_id", F.concat(F.lit("field-"), "field_name").alias("node_id"), F.lit("field").alias("node_type"),
        F.concat("label", F.lit(": "), "consensus_value").alias("label"),
        F.when(state == "unanimous", "verified").when(state == "majority_conflict", "mismatch")
        .otherwise("warning").alias("status"),
        F.coalesce("ocr_confidence", F.lit(90.0)).alias("confidence"))
    return person.unionByName(papers).unionByName(values)


def graph_edges(docs: DataFrame, fields: DataFrame, fused: DataFrame) -> DataFrame:
    """Submitted edges to documents; agree or conflict edges from documents to consensus values."""
    paper = F.concat(F.lit("doc-"), "document_id")
    submitted = docs.select("case_id", F.lit("person-root").alias("source"), paper.alias("target"),
                            F.lit("submitted").alias("label"), F.lit("neutral").alias("status"))
    # a case has a value for each fused field at most, so they travel as one row and ``fields`` can stay where their case is
    agreed = fused.filter(F.coalesce("consensus_value", F.lit("")) != "").dropna(subset=_KEYS).groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "consensus_value"))).alias("_agreed"))
    field = F.col("field_name")
    voting = fields.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(agreed, "case_id").withColumn(
        "consensus_value", F.try_element_at("_agreed", field))
    votes = voting.filter(F.col("consensus_value").isNotNull()).select(
        "case_id", paper.alias("source"), F.concat(F.lit("field-"), field).alias("target"),
        F.trim("value").alias("label"),
        F.when(forms_agree(field, canonical(field, F.trim("value")), canonical(field, F.col("consensus_value"))),
               "agree").otherwise("conflict").alias("status"))
    return submitted.unionByName(votes)


def document_titles(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", document_label("document_type").alias("title"))

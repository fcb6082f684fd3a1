"""Every operator as a query over the tables of a folder: name → (spark, folder) → DataFrame."""
from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossier import policy
from dossier.functions import crypto, dates, shapes, text
from dossier.operators import (access, agreement, analytics, audit, extraction, forensics, fusion, listing, notices,
                               report, reuse, risk, rules, search, validation)
from dossier.plans.screening import Screening
from dossier.session import cut, cut_by, shared_dir
from dossier.sources import files, sinks
from dossier.sources.bindings import EVENTS_AS_OF, Bindings, as_of
from dossier.streaming import jobs

KEY = b"dossier-example-key-0123456789ab"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
    """Register under the function's name."""
    QUERIES[function.__name__] = lambda spark, folder: function(Bindings(spark, folder))
    return function


def iso(df: DataFrame, *names: str) -> DataFrame:
    """Dates as ISO text, so that every engine prints them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _vectors(b: Bindings) -> DataFrame:
    return b.raw("embeddings").select(F.floor(F.col("vec_id") / 8).alias("case_id"), "vec_id", "embedding")


def _face_findings(b: Bindings) -> DataFrame:
    return reuse.face_findings(reuse.feature_match(_vectors(b), match=35, borderline=20))


def screened(b: Bindings) -> Screening:
    """The screening over all evidence: documents, fields, image findings, codes, machine zones and photos."""
    docs = b.docs.withColumn("ocr_mean_confidence", F.when(F.col("l_linestatus") == "F", F.col("confidence")))
    return Screening(b.cases, docs, b.fields_by_case, as_of(), b.forensics, b.payloads_by_document, b.lines,
                     _face_findings(b), (b.docs_by_document, b.fields_by_document), b.parts, not b.has_hot_case)


# ---- scans, sources, sinks --------------------------------------------------------------

@query
def table_counts(b: Bindings) -> DataFrame:
    from dossier.sources.tables import TABLES, load
    tables = load(b.spark, b.folder)
    rows = [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query
def intake_check(b: Bindings) -> DataFrame:
    """Text evidence as files; some names and sizes are made to fail."""
    n = F.col("doc_id")
    suffix = F.when(n % 7 == 0, ".pdf").when(n % 11 == 0, ".exe").otherwise(".TXT")
    content = F.when(n % 13 == 0, F.lit("")).otherwise(F.col("text"))
    rows = b.raw("documents").select("doc_id", F.concat(F.lit("in\\box/"), "source", F.lit("-"), n.cast("string"),
                                                        suffix).alias("path"),
                                     F.encode(content, "UTF-8").alias("content"))
    return files.intake_check(rows).select("doc_id", "filename", "mime", "byte_size", "accepted",
                                           F.coalesce("reason", F.lit("")).alias("reason"))


@query
def screen_upload(b: Bindings) -> DataFrame:
    n = F.col("doc_id")
    rows = b.raw("documents").select(
        "doc_id", F.concat(F.lit("up/ "), "source", F.lit("#"), n.cast("string"),
                           F.when(n % 3 == 0, ".PNG").when(n % 3 == 1, ".pdf").otherwise(".txt")).alias("path"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "image/png").otherwise("application/pdf").alias("declared_mime"),
        F.when(n % 17 == 0, 0).otherwise(F.col("n_chars")).alias("byte_size"))
    return files.screen_upload_check(rows).select("doc_id", "safe_name", "accepted",
                                                  F.coalesce("reason", F.lit("")).alias("reason"))


@query
def html_text(b: Bindings) -> DataFrame:
    body = files.html_text("html")
    return b.raw("pages").select("page_id", body.alias("text"),
                                 F.when(body == "", "no_text").otherwise("extracted").alias("extraction_status"))


def _docx_of(texts: DataFrame) -> DataFrame:
    """Texts (doc_id, text) as DOCX files, a paragraph for each line; some are cut off or lack the document part."""
    def packed(doc: int, text: str) -> bytes:
        lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("other.xml" if doc % 50 == 11 else files.DOCX_PART, f'<w:document xmlns:w="urn:w"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()[:-40] if doc % 50 == 7 else out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"path": [f"/in/{d}.docx" for d in rows["doc_id"]],
                                "content": [packed(d, t) for d, t in zip(rows["doc_id"], rows["text"])]})

    return texts.mapInPandas(run, "path string, content binary")


@query
def evidence_files(b: Bindings) -> DataFrame:
    """Every document as a file, each third a DOCX, the others plain text: the gate's verdict and the text read back."""
    docs = b.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.filter(F.col("doc_id") % 3 != 0).select(
        F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    given = cut(plain.unionByName(_docx_of(docs.filter(F.col("doc_id") % 3 == 0))))
    judged = files.intake_check(given).select("path", "accepted", "reason")
    return judged.join(files.extract_text(given), "path").select(
        F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "accepted", "reason", "extraction_status",
        F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def blob_check(b: Bindings) -> DataFrame:
    """Each version against its sealed file; some files are lost, changed or sealed over another text, some keys are no keys."""
    number = F.col("version_id") % 50
    versions = b.versions.select(
        "version_id", "sha256", F.concat(F.md5(F.col("version_id").cast("string")),
                                         F.when(number == 9, ".tmp").otherwise(".vault")).alias("storage_key"), "text")
    content = F.when(number == 5, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    sealed = files.seal(content.cast("binary"), KEY)
    broken = F.when(number == 3, F.concat(F.substring(sealed, 1, 20), F.lit(b"changed"))).otherwise(sealed)
    blobs = versions.filter(number != 1).select(F.concat(F.lit("/vault/"), "storage_key").alias("path"), broken.alias("content"))
    return files.verify_blobs(versions.drop("text"), blobs, KEY).select("version_id", "verified", "reason")


@query
def content_fingerprint(b: Bindings) -> DataFrame:
    return files.with_sha256(b.raw("documents"), "text").select("doc_id", "sha256")


@query
def encrypted_roundtrip(b: Bindings) -> DataFrame:
    sealed = b.versions.select("version_id", "text", crypto.encrypt_text("text", KEY, "extracted-text").alias("sealed"))
    opened = crypto.decrypt_text("sealed", KEY, "extracted-text")
    return sealed.select("version_id", F.col("sealed").startswith("enc:v1:").alias("marked"),
                         (opened == F.col("text")).alias("same"),
                         crypto.decrypt_text("sealed", KEY, "other").isNull().alias("other_context_refused"))


@query
def payload_parse(b: Bindings) -> DataFrame:
    """Objects in the event properties."""
    return validation.parse_payload(b.raw("events"), "props").select(
        "event_id", F.try_element_at("object", F.lit("k")).try_cast("bigint").alias("k"))


@query
def audit_csv_lines(b: Bindings) -> DataFrame:
    events = access.with_name(b.audit, b.users, "actor_id", "System").select(
        "id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("name").alias("actor_name"), "action", F.col("segment").alias("case_id"),
        F.lit(None).cast("string").alias("target_id"), F.sha2("details", 256).alias("event_hash"))
    return sinks.quoted_line(sinks.audit_rows(events))


@query
def version_numbers(b: Bindings) -> DataFrame:
    """Text versions arrive after those with odd ids were stored."""
    stored = b.versions.filter(F.col("version_id") % 2 == 1)
    existing = stored.groupBy("document_id").agg(F.count("*").alias("number"))
    incoming = b.versions.filter(F.col("version_id") % 2 == 0).select(
        "version_id", "document_id", F.col("version_id").alias("arrival"))
    return sinks.next_versions(existing, incoming).select(
        "version_id", "document_id", F.col("number").cast("bigint").alias("number"))


# ---- access ------------------------------------------------------------------------------

def _visits(b: Bindings) -> DataFrame:
    lead = b.cases.select("case_id", F.col("lead_user_id").alias("user_id"))
    other = b.cases.select("case_id", (F.col("case_id") % 150).alias("user_id"))
    return lead.unionByName(b.members.select("case_id", "user_id")).unionByName(other).distinct()


def _someone(every: int) -> Column:
    key = F.col("case_id")
    return F.when(key % every == 0, key % 150).otherwise(F.col("lead_user_id"))


@query
def visible_cases(b: Bindings) -> DataFrame:
    return access.grants(b.cases, b.members, b.users).withColumn(
        "case_id", F.coalesce(F.col("case_id").cast("string"), F.lit("*")))


@query
def edit_rights(b: Bindings) -> DataFrame:
    return access.edit_rights(b.cases, b.members, b.users, _visits(b))


@query
def archival_gate(b: Bindings) -> DataFrame:
    key = F.col("case_id")
    requests = b.cases.select(
        "case_id", _someone(4).alias("user_id"),
        F.when(key % 3 == 0, "archived").when(key % 3 == 1, "active").alias("new_status"),
        F.when(key % 5 == 0, False).when(key % 5 == 1, True).alias("new_hold"), (key % 7 == 0).alias("other_change"))
    return access.archival_gate(b.cases, b.members, b.users, requests).select("case_id", "user_id", "verdict")


@query
def member_gate(b: Bindings) -> DataFrame:
    key = F.col("case_id")
    target = F.when(key % 10 == 0, F.col("lead_user_id")).otherwise(key * 3 % 150)
    requests = b.cases.select(
        "case_id", _someone(4).alias("user_id"), target.alias("target_id"),
        F.when(key % 2 == 0, "add").otherwise("remove").alias("action"),
        F.when(key % 3 == 0, "viewer").otherwise("editor").alias("new_access"))
    return access.member_gate(b.cases, b.members, b.users, requests).select(
        "case_id", "user_id", "target_id", "verdict")


@query
def review_request_gate(b: Bindings) -> DataFrame:
    key = F.col("case_id")
    asked = F.when(key % 2 == 0, key * 5 % 150).otherwise(F.col("lead_user_id"))
    requests = b.cases.select("case_id", _someone(5).alias("user_id"), asked.alias("assigned_to"))
    return access.review_request_gate(b.cases, b.members, b.users, requests).select(
        "case_id", "user_id", "assigned_to", "verdict")


def _decided(b: Bindings) -> DataFrame:
    key = F.col("review_id")
    decisions = b.reviews.select(
        "review_id", F.when(key % 6 == 0, key % 150).otherwise(F.col("assigned_to")).alias("user_id"),
        F.when(key % 4 == 0, "approved").otherwise("rejected").alias("decision"))
    return access.review_decision_gate(b.cases, b.members, b.users, b.reviews, decisions)


@query
def review_gate(b: Bindings) -> DataFrame:
    return _decided(b).select("review_id", "case_id", "user_id", "verdict", "case_status")


@query
def reviewed_cases(b: Bindings) -> DataFrame:
    return access.apply_reviews(b.cases, _decided(b)).groupBy("status").agg(F.count("*").alias("cases"))


@query
def review_queue(b: Bindings) -> DataFrame:
    return access.review_queue(b.reviews, b.users, as_of()).select(
        "assigned_to", "assigned_name", "pending", "due", "first_due")


@query
def retention_due(b: Bindings) -> DataFrame:
    return iso(access.retention_due(b.cases, as_of()).select("case_id", "reference", "retention_until"),
               "retention_until")


@query
def account_checks(b: Bindings) -> DataFrame:
    """Input rules of accounts and cases as data-quality flags."""
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                    F.when(F.col("c_custkey") % 9 == 0, " at home").otherwise("@example.org"))
    return b.raw("customer").select(
        F.col("c_custkey").alias("user_id"), mail.rlike(policy.EMAIL_PATTERN).alias("email_ok"),
        F.length("c_name").between(2, 160).alias("name_ok"),
        F.col("c_mktsegment").rlike(policy.REFERENCE_PATTERN).alias("reference_ok"))


# ---- listings ------------------------------------------------------------------------------

@query
def case_search(b: Bindings) -> DataFrame:
    return listing.case_search(b.cases, " urgent ", "active").select("case_id", "reference", "title", "status")


@query
def case_search_wildcards(b: Bindings) -> DataFrame:
    """``_`` and ``%`` of the term work as wildcards."""
    return listing.case_search(b.cases, "case/1_%9").select("case_id", "reference")


@query
def recent_cases(b: Bindings) -> DataFrame:
    top = listing.top_n(b.cases, [F.col("created_on").desc(), F.col("case_id").desc()], 100)
    return iso(top.select("case_id", "reference", "status", "created_on"), "created_on")


@query
def documents_of_kind(b: Bindings) -> DataFrame:
    docs = b.docs.withColumnRenamed("document_type", "kind")
    return listing.by_kind(docs, "voter_id").groupBy("case_id").agg(F.count("*").alias("documents"))


@query
def recent_documents(b: Bindings) -> DataFrame:
    top = listing.top_n(b.docs, [F.col("issue_d").desc(), F.col("document_id").desc()], 200)
    return iso(top.select("document_id", "case_id", "document_type", "issue_d"), "issue_d")


@query
def recent_audit(b: Bindings) -> DataFrame:
    """Newest events on cases of one user, with actor names."""
    seen = b.audit.withColumn("case_id", F.col("segment").cast("bigint"))
    mine = access.visible_to(b.cases, b.members, 5, "investigator")
    top = listing.top_n(listing.audit_filter(seen, mine), [F.col("id").desc()], 300, 1, 300)
    return access.with_name(top, b.users, "actor_id", "System").select(
        "id", "case_id", "action", F.col("name").alias("actor_name"))


@query
def audit_text(b: Bindings) -> DataFrame:
    events = access.with_name(b.audit.withColumn("case_id", F.col("segment")), b.users, "actor_id", "System") \
        .withColumnRenamed("name", "actor_name")
    return listing.audit_text(events, "PURCHASE customer#00000001").select("id", "action", "actor_name")


@query
def cases_in_range(b: Bindings) -> DataFrame:
    return listing.in_range(b.cases, "created_on", "90d", as_of()).groupBy("status").agg(
        F.count("*").alias("cases"))


@query
def history_listing(b: Bindings) -> DataFrame:
    """Cases of people named *red*, sent to manual review, riskiest first."""
    found = listing.history_search(b.cases, report.people(b.fields), "red")
    kept = listing.outcome_filter(found, "high_risk")
    return listing.history_page(kept, "risk_desc", 500).select("case_id", "person", "overall_risk", "recommendation")


@query
def history_by_number(b: Bindings) -> DataFrame:
    return listing.history_search(b.cases, report.people(b.fields), "#77").select("case_id", "person")


@query
def recent_screenings(b: Bindings) -> DataFrame:
    return report.recent_screenings(b.cases, b.docs, b.fields, analytics.outcome_bucket(), 8)


@query
def display_labels(b: Bindings) -> DataFrame:
    return b.docs.groupBy("document_type").agg(F.count("*").alias("documents")).select(
        "document_type", "documents", listing.document_label("document_type").alias("label"),
        listing.label_of("document_type", {"pan": "Tax card"}).alias("short_label"))


@query
def case_card(b: Bindings) -> DataFrame:
    versions = b.docs.select("case_id", F.col("document_id").alias("version_id"),
                             F.col("file_name").alias("filename"), F.col("issue_d").alias("created_on"))
    return listing.case_card(b.cases, b.docs, versions)


@query
def latest_versions(b: Bindings) -> DataFrame:
    return listing.latest(b.versions, ["document_id"], F.col("version_id"), "version_id", "filename", "sha256")


@query
def version_history(b: Bindings) -> DataFrame:
    """All versions of each document, the newest first."""
    return listing.version_history(b.versions.withColumn("number", F.col("version_id"))).select(
        "document_id", "version_id", F.col("rank").alias("position"))


@query
def case_people(b: Bindings) -> DataFrame:
    return report.people(b.fields)


@query
def joined_notes(b: Bindings) -> DataFrame:
    """Texts of a conversation in order, as long texts in parts."""
    rows = b.raw("conversations")
    return listing.joined_text(rows, ["conv_id"], "text", ["turn"], "; ").select("conv_id", "part_no", "text")


@query
def case_detail(b: Bindings) -> DataFrame:
    """Documents, members and reviews of every case, counted apart before they meet."""
    docs = b.docs.groupBy("case_id").agg(F.count("*").alias("documents"), F.max("issue_d").alias("newest"))
    people = b.members.groupBy("case_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("access") == "editor").alias("editors"))
    reviews = b.reviews.groupBy("case_id").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    rows = b.cases.select("case_id", "reference").join(docs, "case_id", "left").join(people, "case_id", "left").join(
        reviews, "case_id", "left").fillna(0, ["documents", "members", "editors", "pending"])
    return iso(rows, "newest")


# ---- analytics ------------------------------------------------------------------------------

@query
def workspace_summary(b: Bindings) -> DataFrame:
    return analytics.workspace_summary(b.cases, access.grants(b.cases, b.members, b.users), b.docs, b.reviews)


@query
def dashboard_summary(b: Bindings) -> DataFrame:
    return analytics.dashboard_summary(b.cases)


@query
def analytics_kpis(b: Bindings) -> DataFrame:
    return analytics.kpis(b.cases, b.docs, screened(b).face_rows, b.stages)


@query
def volume_trend(b: Bindings) -> DataFrame:
    return analytics.volume_trend(listing.in_range(b.cases, "created_on", "90d", as_of()), 90, as_of())


@query
def volume_trend_floor(b: Bindings) -> DataFrame:
    return analytics.volume_trend(listing.in_range(b.cases, "created_on", "30d", as_of()), 30, as_of(), "floor")


@query
def risk_distribution(b: Bindings) -> DataFrame:
    return analytics.risk_distribution(b.cases)


@query
def discrepancy_ranking(b: Bindings) -> DataFrame:
    s = screened(b)
    return analytics.discrepancy_ranking(s.findings)


@query
def document_type_mix(b: Bindings) -> DataFrame:
    return analytics.type_mix(b.docs, screened(b).statuses)


@query
def analytics_export(b: Bindings) -> DataFrame:
    """The four sections written as CSV datasets, and the lines read back from them."""
    s = screened(b)
    sections = sinks.analytics_sections(
        analytics.kpis(b.cases, b.docs, s.face_rows, b.stages),
        analytics.volume_trend(listing.in_range(b.cases, "created_on", "90d", as_of()), 90, as_of()),
        analytics.discrepancy_ranking(s.findings), analytics.type_mix(b.docs, s.statuses))
    folder = f"{shared_dir(b.spark)}/analytics-{uuid.uuid4().hex}"
    sinks.export_analytics(sections, folder)
    return sinks.exported_lines(b.spark, sections, folder)


@query
def signal_rates(b: Bindings) -> DataFrame:
    s = screened(b)
    return analytics.signal_rates(s.findings_table, b.forensics, s.validations_table, b.cases)


@query
def stage_latency(b: Bindings) -> DataFrame:
    return analytics.stage_latency(b.stages)


@query
def stage_rollup(b: Bindings) -> DataFrame:
    """Event kinds as stages of segments; errors fail, slow purchases lack recognition."""
    kind = F.col("stage_key")
    stages = b.stages.select(
        "case_id", "order_index",
        F.when(kind == "click", "classify").when(kind == "view", "fields").otherwise(kind).alias("stage_key"),
        F.when((kind == "error") & (F.col("duration_ms") > 2500), "error")
        .when((kind == "purchase") & (F.col("duration_ms") > 1800), "unavailable")
        .when(F.col("duration_ms") > 1500, "warning").otherwise("done").alias("outcome"))
    return analytics.stage_rollup(stages)


@query
def insights(b: Bindings) -> DataFrame:
    s = screened(b)
    figures = analytics.kpis(b.cases, b.docs, s.findings_table, b.stages)
    return analytics.insights(figures, analytics.discrepancy_ranking(s.findings_table), analytics.signal_rates(
        s.findings_table, b.forensics, s.validations_table, b.cases))


@query
def case_numbers(b: Bindings) -> DataFrame:
    """Cases opened from 1998 on are numbered after the others."""
    old = b.cases.filter(F.col("created_on") < "1998-01-01").select((F.col("case_id") + 2000).alias("case_number"))
    new = b.cases.filter(F.col("created_on") >= "1998-01-01").select(
        "case_id", F.col("created_on").alias("created_at"))
    return analytics.number_cases(old, new).select("case_id", "case_number")


# ---- text, search -------------------------------------------------------------------------------

@query
def normalised_fields(b: Bindings) -> DataFrame:
    return extraction.normalized(b.fields).select("document_id", "field_name", "normalized_value")


@query
def folded_text(b: Bindings) -> DataFrame:
    return b.raw("conversations").select("conv_id", "turn", text.normalize_name("text").alias("folded"))


@query
def search_index(b: Bindings) -> DataFrame:
    return search.build_index(b.versions, KEY)


def _asked(b: Bindings) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,40}"), F.lit(0))
    return b.raw("benchmark").select(F.col("item_id").alias("query_id"),
                                     F.array_join(words, " ").alias("text"))


@query
def evidence_search(b: Bindings) -> DataFrame:
    index = cut(search.build_index(b.versions, KEY))  # as the stored index of a deployment
    return search.all_terms(index, search.query_words(_asked(b), KEY))


@query
def document_search(b: Bindings) -> DataFrame:
    """One user's search by file name or words; the newest hundred."""
    docs = b.versions.groupBy("document_id").agg(
        F.max("version_id").alias("created_on"), F.min("source").alias("title"), F.min("lang").alias("kind"))
    index = cut(search.build_index(b.versions, KEY))
    return search.search_documents(docs, b.versions, index, "the with", KEY, kind="en", limit=100).select(
        "document_id", "created_on")


# ---- consistency and fusion ---------------------------------------------------------------------

@query
def name_agreement(b: Bindings) -> DataFrame:
    return agreement.name_versus_first(b.fields)


@query
def address_agreement(b: Bindings) -> DataFrame:
    return agreement.name_versus_first(b.fields, "address").select("case_id", "document_id", "agrees")


@query
def consistency_findings(b: Bindings) -> DataFrame:
    values = agreement.field_values(b.fields_by_case)
    return agreement.consistency(*agreement.cluster_parts(values, together=not b.has_hot_case))


def _case_values(b: Bindings) -> DataFrame:
    """Values of the fields, written once; those of a case stay in one part, so that what groups by case moves no more."""
    values = agreement.field_values(b.fields_by_case)
    return cut(values) if b.has_hot_case else cut_by(values, "case_id", b.parts)


def _case_clusters(b: Bindings, values: DataFrame) -> list[DataFrame]:
    """Their clusters: plain fields as they lie, names and addresses dealt by case like them."""
    plain, fuzzy = agreement.cluster_parts(values, together=not b.has_hot_case)
    return [plain, fuzzy if b.has_hot_case else fuzzy.repartition(b.parts, "case_id")]


@query
def conflict_parts(b: Bindings) -> DataFrame:
    """Wording of the conflicts over every field, by cluster of agreeing documents."""
    fuzzy = agreement.is_fuzzy(F.col("field_name"))
    parts = [agreement.conflict_parts(agreement.finding_members(b.fields_by_case.filter(own), clustered), agreement.consistency(clustered))
             for own, clustered in zip((~fuzzy, fuzzy), _case_clusters(b, _case_values(b)))]
    return parts[0].unionByName(parts[1]).select(
        "case_id", "field_name", "type_key", "cluster_document", "part_no", "part")


@query
def field_names(b: Bindings) -> DataFrame:
    return agreement.field_names(b.fields).groupBy("field_name").agg(F.count("*").alias("cases"))


@query
def comparison_table(b: Bindings) -> DataFrame:
    values = _case_values(b)
    supported = agreement.support_parts(values, together=not b.has_hot_case)
    parts = [agreement.comparison(part, agreement.consistency(clustered))
             for part, clustered in zip(supported, _case_clusters(b, values))]
    return parts[0].unionByName(parts[1])


@query
def comparison_order(b: Bindings) -> DataFrame:
    """The comparison of each case as it is read: conflicts first."""
    return listing.mismatch_first(comparison_table(b)).select("case_id", "position", "field_name", "status")


@query
def fusion_matrix(b: Bindings) -> DataFrame:
    return screened(b).fused


@query
def evidence_nodes(b: Bindings) -> DataFrame:
    s = screened(b)
    docs = b.docs.select("*", F.when(F.col("doc_ord") == 7, "error").otherwise("done").alias("processing_status"),
                         (F.col("confidence") / 100).alias("type_confidence"))
    return fusion.graph_nodes(b.cases, docs, s.fused)


@query
def evidence_edges(b: Bindings) -> DataFrame:
    return fusion.graph_edges(b.docs, b.fields_by_case.filter(F.col("field_name").isin(*policy.FUSED_FIELDS)),
                              screened(b).fused)


@query
def name_similarity(b: Bindings) -> DataFrame:
    return rules.name_similarity(b.fields)


# ---- checks of documents --------------------------------------------------------------------------

@query
def validation_checks(b: Bindings) -> DataFrame:
    return validation.validate_documents(validation.by_document(b.docs, b.fields), as_of())


@query
def missing_fields(b: Bindings) -> DataFrame:
    return validation.missing_required(b.docs, b.fields).select("case_id", "document_id", "document_type",
                                                                "field_name")


@query
def document_status(b: Bindings) -> DataFrame:
    return screened(b).statuses


@query
def extraction_completeness(b: Bindings) -> DataFrame:
    return validation.completeness(b.docs, b.fields)


@query
def text_status(b: Bindings) -> DataFrame:
    """Quality labels as checks of the text documents."""
    docs = b.raw("documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("case_id"),
                                     F.col("lang").alias("document_type"))
    labels = b.raw("labels")
    checks = labels.select(F.col("doc_id").alias("document_id"),
                           F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("status")).unionByName(
        labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("document_id"),
                                                  F.lit("warning").alias("status")))
    wide = docs.withColumn("n_fields", F.when(F.col("document_type") != "de", 1).otherwise(0))
    return validation.document_status(wide, checks).select("document_id", "passed", "failed", "warned",
                                                                   "status")


def _wide(b: Bindings, *names: str) -> DataFrame:
    """Columns of the wide documents, written once for rules that pass over them several times."""
    return cut(validation.by_document(b.docs_by_document, b.fields_by_document).select("case_id", *names))


@query
def rule_age(b: Bindings) -> DataFrame:
    return rules.rule_age(_wide(b, "document_id", "document_type", "file_name", "doc_ord", "born", "date_of_birth", "issued"))


@query
def rule_dates(b: Bindings) -> DataFrame:
    wide = validation.by_document(b.docs, b.fields)
    return rules.rule_dates(wide, rules.date_issues(wide, as_of()))


@query
def date_issues(b: Bindings) -> DataFrame:
    return rules.date_issues(validation.by_document(b.docs, b.fields), as_of()).select("document_id", "issue_no", "issue")


@query
def rule_pan(b: Bindings) -> DataFrame:
    return rules.rule_pan(validation.by_document(b.docs, b.fields))


@query
def rule_parent(b: Bindings) -> DataFrame:
    """The rule for parent names, run over the printed full names."""
    return rules.rule_parent(_wide(b, "document_id", "file_name", "doc_ord", "full_name"), "full_name")


@query
def mrz_check_digits(b: Bindings) -> DataFrame:
    return b.printed.select("document_id", shapes.check_digit(F.rpad(F.upper("document_number"), 9, "<"))
                            .alias("number_digit"),
                            shapes.check_digit(F.date_format("dob_d", "yyMMdd")).alias("dob_digit"))


@query
def mrz_parse(b: Bindings) -> DataFrame:
    zones = validation.mrz_parse(b.lines, F.lit(EVENTS_AS_OF).cast("date"))
    return zones.select("document_id", "score", "doc_code", "issuing_state", "surname", "given_names",
                        "document_number", "nationality", "dob", "sex", "expiry", "personal_number",
                        *[F.col(f"checks.{c}").alias(f"{c}_ok") for c in
                          ("document_number", "date_of_birth", "expiry_date", "personal_number", "composite")])


@query
def mrz_compare(b: Bindings) -> DataFrame:
    zones = cut(validation.mrz_parse(b.lines, as_of()))
    return validation.mrz_compare(zones, validation.by_document(b.docs, b.fields)).select("document_id", "check_type", "status", "message")


@query
def qr_compare(b: Bindings) -> DataFrame:
    return validation.qr_compare(b.payloads, validation.by_document(b.docs, b.fields)).select("document_id", "check_type", "status", "message")


@query
def extract_fields(b: Bindings) -> DataFrame:
    zones = cut(validation.mrz_parse(b.lines, F.lit(EVENTS_AS_OF).cast("date")))
    return extraction.extract_fields(b.lines, zones).select("document_id", "field_name", "normalized_value",
                                                            "confidence")


@query
def merged_lines(b: Bindings) -> DataFrame:
    """A second pass repeats the lower lines from an enlarged strip."""
    page = b.lines.select("document_id", F.lit(1).alias("pass_no"), "line_no", "text", "x", "y", "confidence",
                          F.lit(0).alias("offset_y"), F.lit(1.0).alias("scale"))
    strip = b.lines.filter(F.col("y") >= 400).select(
        "document_id", F.lit(2).alias("pass_no"), "line_no",
        F.when(F.col("line_no") == 6, F.lit("VALID till")).otherwise(F.upper("text")).alias("text"), "x",
        ((F.col("y") - 400) * 2).alias("y"), "confidence", F.lit(400).alias("offset_y"), F.lit(2.0).alias("scale"))
    return extraction.merge_lines(page.unionByName(strip)).groupBy("document_id").agg(
        F.count("*").alias("lines"), F.max("pass_no").alias("last_pass"), F.max("y").alias("lowest"))


@query
def mean_confidence(b: Bindings) -> DataFrame:
    return extraction.mean_confidence(b.lines)


@query
def classify_text(b: Bindings) -> DataFrame:
    """Types of the printed documents by the words of their lines."""
    texts = b.printed.select("document_id", F.concat_ws(
        " ", F.upper(F.replace("document_type", F.lit("_"), F.lit(" "))),
        F.when(F.col("document_type") == "passport", "REPUBLIC OF INDIA SURNAME NATIONALITY P<IND TYPE P")
        .when(F.col("document_type") == "pan", "INCOME TAX DEPARTMENT PERMANENT ACCOUNT NUMBER")
        .when(F.col("document_type") == "voter_id", "ELECTION COMMISSION VOTER EPIC NO IDENTITY CARD ELECTOR"),
        "document_number", "full_name").alias("text"))
    return extraction.classify(texts)


@query
def classify_documents(b: Bindings) -> DataFrame:
    texts = b.texts.select(F.col("doc_id").alias("document_id"), "text")
    return extraction.classify(texts, uncertain="unknown")


# ---- reuse, features ----------------------------------------------------------------------------------

@query
def exact_reuse(b: Bindings) -> DataFrame:
    docs = b.versions.select(F.col("version_id").alias("document_id"), F.col("source").alias("case_id"),
                             F.col("sha256").alias("file_hash"))
    return reuse.same_hash(docs).select("document_id", "hits", "other_document_id", "same_case")


@query
def reuse_hits(b: Bindings) -> DataFrame:
    docs = b.versions.select(F.col("version_id").alias("document_id"), F.col("source").alias("case_id"),
                             F.col("sha256").alias("file_hash"))
    return reuse.listed_hits(docs, most=5).select("file_hash", "document_id", "other_document_id", "rank")


@query
def reuse_messages(b: Bindings) -> DataFrame:
    return reuse.reuse_rows(reuse.same_hash(b.docs.select("document_id", "case_id", "file_hash"))).select(
        "document_id", "message")


@query
def near_reuse(b: Bindings) -> DataFrame:
    docs = reuse.with_simhash(b.texts.select(F.col("doc_id").alias("document_id"), "text"))
    return reuse.near_hash(docs.select("document_id", "near_hash")).select(
        "document_a", "document_b", "copies_a", "copies_b", F.col("distance").cast("int").alias("distance"))


@query
def feature_match(b: Bindings) -> DataFrame:
    return reuse.feature_match(_vectors(b), match=35, borderline=20)


@query
def face_findings(b: Bindings) -> DataFrame:
    return _face_findings(b)


# ---- image figures ----------------------------------------------------------------------------------

def _figures(b: Bindings) -> DataFrame:
    n = F.col("l_partkey")
    return b.docs.select(
        "document_id", (F.col("l_quantity") * 4).alias("sharpness"), (n % 1400 + 300).cast("int").alias("width"),
        (F.col("l_suppkey") * 13 % 1300 + 300).cast("int").alias("height"), (F.col("l_discount") * 2).alias("glare"),
        (n % 256).cast("double").alias("brightness"), (F.col("l_tax") * 70).alias("moire"),
        (n % 90).cast("double").alias("contrast"))


@query
def quality_verdict(b: Bindings) -> DataFrame:
    return forensics.quality_verdict(_figures(b)).select("document_id", "sharpness_status", "resolution_status",
                                                         "glare_status", "status", "trust_ocr")


@query
def capture_verdict(b: Bindings) -> DataFrame:
    return forensics.capture_verdict(_figures(b)).select("document_id", "capture_status", "capture_risk")


@query
def document_suspicion(b: Bindings) -> DataFrame:
    return forensics.suspicion(b.docs, b.forensics)


@query
def signature_scan(b: Bindings) -> DataFrame:
    """Editor names in page sources, here the words a page of the tables can hold."""
    pages = b.raw("pages").select(F.col("page_id").alias("document_id"), "html")
    return forensics.signature_scan(pages, "html", (*policy.EDITOR_NAMES, "meta charset", "track(")).select(
        "document_id", "tools", "severity", "score")


@query
def zones(b: Bindings) -> DataFrame:
    x, y = (F.col("l_partkey") % 100) / 99.0, (F.col("l_suppkey") * 7 % 100) / 99.0
    return b.docs.select("document_id", forensics.zone_of(x, y, F.col("document_type")).alias("region"))


@query
def overlap_suppression(b: Bindings) -> DataFrame:
    boxes = b.docs.select(
        F.col("case_id").cast("string").alias("document_id"), F.col("document_id").alias("ord"),
        (F.col("l_partkey") % 40 * 10).cast("int").alias("x"), (F.col("l_suppkey") % 30 * 10).cast("int").alias("y"),
        (F.col("l_quantity") * 4 + 40).cast("int").alias("w"), F.lit(120).alias("h"))
    return forensics.suppress_overlap(boxes, 0.3).select("document_id", "ord")


@query
def displacement_votes(b: Bindings) -> DataFrame:
    """Matched points per supplier; shifts repeat where quantities do."""
    n = F.col("l_partkey")
    pairs = b.docs.select(
        (F.col("l_suppkey") * 100 + F.col("doc_ord")).cast("string").alias("document_id"), "document_type",
        F.lit(1000).alias("width"), F.lit(700).alias("height"), (n % 400).cast("double").alias("x1"),
        (n % 300).cast("double").alias("y1"),
        (n % 400 + F.floor(F.col("l_quantity") / 10) * 60 + 30).cast("double").alias("x2"),
        (n % 300 + 72).cast("double").alias("y2")).withColumn("document_type", F.lit("pan"))
    return forensics.displacement_votes(pairs).select("document_id", "region", "score", "severity", "vx", "vy",
                                                      "votes", "x0", "y0", "w", "h")


@query
def hot_clusters(b: Bindings) -> DataFrame:
    """Cells of a 12 by 12 grid per supplier, valued by the lines that fall on them."""
    cells = b.docs.groupBy(
        F.col("l_suppkey").cast("string").alias("document_id"), (F.col("l_partkey") % 12).cast("int").alias("cx"),
        (F.floor(F.col("l_partkey") / 12) % 12).cast("int").alias("cy")).agg(
        F.max("l_quantity").alias("value")).select(
        "*", F.lit("passport").alias("document_type"), F.lit(12).alias("grid_w"), F.lit(12).alias("grid_h"))
    return forensics.hot_clusters(cells, 47.0, 60.0).select(
        "document_id", "region", "score", "severity", "area", "x0", "y0", "cells_w", "cells_h")


# ---- risk, report, notices ----------------------------------------------------------------------------

@query
def case_evidence(b: Bindings) -> DataFrame:
    return screened(b).evidence


@query
def risk_ledger(b: Bindings) -> DataFrame:
    return screened(b).ledger


@query
def risk_score(b: Bindings) -> DataFrame:
    return screened(b).scores


@query
def ledger_positions(b: Bindings) -> DataFrame:
    return risk.ledger_order(screened(b).ledger).select("case_id", "factor", "score", "position")


@query
def capped_sums(b: Bindings) -> DataFrame:
    """Findings per case and severity, weighted with caps."""
    level = F.col("severity")
    rows = b.forensics.groupBy("case_id", "severity").agg(F.count("*").alias("n")).select(
        "case_id", "n", F.when(level == "high", 25).when(level == "medium", 12).otherwise(1).alias("weight"),
        F.when(level == "high", 1).when(level == "medium", 2).alias("cap"))
    return risk.capped_sum(rows, ["case_id"], "weight", "n", "cap")


@query
def risk_bands(b: Bindings) -> DataFrame:
    return report.report_heads(b.cases).groupBy("band", "recommendation").agg(F.count("*").alias("cases"))


@query
def report_modules(b: Bindings) -> DataFrame:
    return screened(b).report_modules


@query
def key_findings(b: Bindings) -> DataFrame:
    s = screened(b)
    return report.key_findings(s.findings_table, b.forensics, s.validations_table)


@query
def report_fields(b: Bindings) -> DataFrame:
    return report.report_fields(b.docs, b.fields, screened(b).statuses).select(
        "document_id", "field_order", "label", "value", "document_status")


@query
def discrepancy_union(b: Bindings) -> DataFrame:
    s = screened(b)
    return notices.discrepancies(s.findings_table, s.failed_table, b.forensics, s.wide).select(
        "case_id", "source", "field_name", "label", "severity", "explanation")


@query
def outbox(b: Bindings) -> DataFrame:
    s = screened(b)
    found = notices.discrepancies(s.findings_table, s.failed_table, b.forensics, s.wide)
    key = F.col("case_id")
    contacts = b.cases.select(
        "case_id", F.when(key % 3 != 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org")))
        .alias("email"), F.when(key % 2 == 0, F.concat(F.lit("+91"), key.cast("string"))).alias("phone"),
        (key % 4 != 0).alias("auto_notify"))
    return notices.notices(b.cases, found, report.people(b.fields), contacts, email_ready=False)


@query
def briefing(b: Bindings) -> DataFrame:
    s = screened(b)
    return report.briefing(b.cases, b.docs, s.findings_table, b.forensics, s.validations_table, report.people(b.fields)).select(
        "case_id", "spoken_text", "has_warnings")


_TABLE_WORDS = (
    (("the ", "with"), "identity", None), (("und ", "der "), "dob", "switch_tab:Documents"),
    (("que ", "los "), "documents", "switch_tab:Documents"), (("des ", "les "), "report", "switch_tab:Report"))


@query
def intent_routes(b: Bindings) -> DataFrame:
    return notices.route_intents(b.raw("conversations"), _TABLE_WORDS).select("conv_id", "turn", "category", "action")


@query
def case_intents(b: Bindings) -> DataFrame:
    """The shipped rules over the turns, sharpened by the facts of the case a conversation belongs to."""
    routed = notices.route_intents(b.raw("conversations")).withColumn("case_id", F.col("conv_id"))
    return notices.refined(routed, screened(b).evidence).groupBy("category", "action").agg(F.count("*").alias("turns"))


@query
def system_intents(b: Bindings) -> DataFrame:
    return notices.system_intents(b.raw("conversations")).select("conv_id", "turn", "category", "action")


# ---- audit ------------------------------------------------------------------------------------------

def _events(b: Bindings) -> DataFrame:
    return b.audit.select(
        audit.chain_name(F.col("segment"), F.col("id")).alias("chain"), "id", "actor_id",
        F.col("segment").alias("case_id"), "action", F.lit(None).cast("string").alias("target_id"), "details",
        "created_at")


@query
def audit_digest(b: Bindings) -> DataFrame:
    return _events(b).select("id", audit.digest(F.lit(policy.GENESIS), KEY).alias("event_hash"))


def _own_digests(b: Bindings) -> DataFrame:
    """Events whose previous hash is the digest of their predecessor taken alone, so no chain is needed."""
    return _events(b).withColumn("event_hash", audit.digest(F.lit(policy.GENESIS), KEY))


@query
def audit_links(b: Bindings) -> DataFrame:
    return audit.link_check(_own_digests(b).withColumn("segment", F.col("case_id")), ["segment"], 2000).select(
        "id", "segment", "expected_previous")


@query
def audit_append(b: Bindings) -> DataFrame:
    none = b.spark.createDataFrame([], "chain string, event_hash string")
    return audit.append_audit(_events(b), none, KEY).select("chain", "id", "previous_hash", "event_hash")


@query
def audit_verify(b: Bindings) -> DataFrame:
    """A true log with damage: a changed action, a broken link, and heads that tell of lost tails."""
    none = b.spark.createDataFrame([], "chain string, event_hash string")
    log = cut(audit.append_audit(_events(b), none, KEY))
    number, segment = F.col("id"), F.col("case_id")
    hurt = log.withColumn("action", F.when(number % 997 == 13, F.lit("edited")).otherwise(F.col("action"))) \
        .withColumn("previous_hash", F.when(number % 1009 == 7, F.lit(policy.GENESIS))
                    .otherwise(F.col("previous_hash")))
    heads = audit.chain_heads(log)
    last = log.groupBy("chain").agg(F.max("id").alias("last"))
    lost = hurt.join(last, "chain").filter(~((segment % 10 == 3) & (number == F.col("last")))).drop("last")
    return audit.verify_audit(lost, heads, KEY)


# ---- streams run over what is there ---------------------------------------------------------------------

def _stream(b: Bindings, name: str) -> DataFrame:
    return b.spark.readStream.schema(b.raw(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(b.folder)


def _run(b: Bindings, stream: DataFrame) -> DataFrame:
    place = f"{shared_dir(b.spark)}/stream-{uuid.uuid4().hex}"
    return jobs.run_available(stream, f"{place}/out", f"{place}/checkpoint")


@query
def stream_lockouts(b: Bindings) -> DataFrame:
    """Errors are failed logins, sign-ups successful ones."""
    attempts = _stream(b, "events").filter(F.col("event_type").isin("error", "signup")).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "signup").alias("success"))
    return _run(b, jobs.lockouts(attempts)).select("event_id", "user_id", "outcome", "late")


@query
def stream_sessions(b: Bindings) -> DataFrame:
    """Sign-ups open a session of their user, clicks use it, errors revoke it."""
    def of(kind: str, time: str) -> DataFrame:
        return _stream(b, "events").filter(F.col("event_type") == kind).select(
            F.col("user_id").cast("string").alias("token"), F.col("ts").cast("timestamp").alias(time), "user_id")

    valid = jobs.session_validity(of("signup", "issued_at"), of("click", "used_at").drop("user_id"),
                                  of("error", "revoked_at").drop("user_id"))
    return _run(b, valid).groupBy("user_id").agg(F.count("*").alias("valid_uses"))


@query
def stream_links(b: Bindings) -> DataFrame:
    """A damaged log read as a stream: changed actions, broken links and lost events."""
    none = b.spark.createDataFrame([], "chain string, event_hash string")
    number = F.col("id")
    whole = audit.append_audit(_events(b), none, KEY)
    log = cut(whole.filter(number % 499 != 11)
              .withColumn("action", F.when(number % 997 == 13, F.lit("edited")).otherwise(F.col("action")))
              .withColumn("previous_hash", F.when(number % 1009 == 7, F.lit(policy.GENESIS)).otherwise(F.col("previous_hash"))))
    source = b.spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rsplit("/", 1)[0])
    return _run(b, jobs.live_links(source, KEY)).groupBy("linked", "sound", "late").agg(F.count("*").alias("events"))


@query
def stream_trend(b: Bindings) -> DataFrame:
    """Daily classes of events, values standing for risk; the last day stays open behind the watermark."""
    cases = _stream(b, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "view", "verification_passed").otherwise("review_recommended")
        .alias("recommendation"), F.col("value").cast("int").alias("overall_risk"))
    return iso(_run(b, jobs.live_trend(cases)), "slot")


@query
def stream_reuse(b: Bindings) -> DataFrame:
    """Event properties as file hashes, those of the first day being known already."""
    arrivals = _stream(b, "events").filter(F.col("ts") >= "2024-01-02").select(
        F.col("event_id").alias("document_id"), F.sha2("props", 256).alias("file_hash"),
        F.col("ts").cast("timestamp").alias("created_at"))
    known = b.raw("events").filter(F.col("ts") < "2024-01-02").select(F.sha2("props", 256).alias("file_hash"))
    return _run(b, jobs.reuse_on_arrival(arrivals, known, "60 days")).select("file_hash").distinct()


@query
def stream_notices(b: Bindings) -> DataFrame:
    """Finished cases leave notices in an outbox, batch by batch."""
    place = f"{shared_dir(b.spark)}/notices-{uuid.uuid4().hex}"
    found = cut(notices.discrepancies(
        consistency_findings(b), validation.validate_documents(
            validation.by_document(b.docs_by_document, b.fields_by_document), as_of()), b.forensics, b.docs))
    people = cut(report.people(b.fields))
    key = F.col("case_id")
    done = _stream(b, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Matter "), "o_orderpriority").alias("title"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("overall_risk"))

    def make(batch: DataFrame) -> DataFrame:
        contacts = batch.select("case_id", F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org"))
                                .alias("email"), F.lit(None).cast("string").alias("phone"),
                                (key % 4 != 0).alias("auto_notify"))
        mine = found.join(batch.select("case_id"), "case_id", "left_semi")
        return notices.notices(batch, mine, people, contacts)

    jobs.auto_notices(done, make, f"{place}/outbox", f"{place}/checkpoint").awaitTermination()
    return b.spark.read.parquet(f"{place}/outbox").groupBy("channel").agg(
        F.count("*").alias("notices"), F.sum("discrepancies").alias("discrepancies"))


# ---- single functions -----------------------------------------------------------------------------------

@query
def scalar_functions(b: Bindings) -> DataFrame:
    """Small functions over part and customer rows."""
    name = F.col("p_name")
    return b.raw("part").select(
        "p_partkey", text.clean_number(F.concat("p_brand", F.lit(" / "), "p_type")).alias("number"),
        text.clean_query(F.concat(F.lit(" Who is, "), name, F.lit("?! "))).alias("asked"),
        text.strip_name_label(F.concat(F.lit("Full Name: NAME "), name)).alias("label_free"),
        text.edit_similarity(name, "p_type").alias("likeness"),
        F.translate("p_brand", "OISBZ", "01582").alias("repaired"),
        dates.short_date(F.concat(F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit("0229")),
                         F.lit("2024-01-31").cast("date")).cast("string").alias("leap_day"),
        files.valid_storage_key(F.concat(F.substring(F.sha2(name, 256), 1, 32), F.lit(".vault"))).alias("key_ok"))


@query
def token_overlap(b: Bindings) -> DataFrame:
    own = b.printed.select("document_id", text.address_tokens("address").alias("a"),
                           text.address_tokens(F.concat("full_name", F.lit(" road delhi"))).alias("b"))
    return own.select("document_id", F.bround(text.token_overlap(F.col("a"), F.col("b")), 4).alias("overlap"),
                      text.tokens_subset(F.col("a"), F.col("b")).alias("subset"))

"""The domain tables of ``dossier.sources.bindings`` as SQL for the check against DuckDB."""

TABLES = {
    "b_users": ((), """
SELECT c_custkey AS user_id, c_name AS name,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'admin' WHEN 'MACHINERY' THEN 'auditor'
                         WHEN 'BUILDING' THEN 'legal' ELSE 'investigator' END AS role,
       c_acctbal >= 0 AS active
FROM customer"""),
    "b_cases": ((), """
SELECT o_orderkey AS case_id, 'CASE/' || o_orderkey AS reference, 'Matter ' || o_orderpriority AS title,
       'Opened for customer ' || o_custkey AS description, o_custkey AS lead_user_id,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'under_review'
            ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'archived' ELSE 'closed' END END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'restricted' WHEN '2-HIGH' THEN 'confidential'
            ELSE 'internal' END AS classification,
       o_orderpriority = '1-URGENT' AS legal_hold, CAST(o_orderdate AS DATE) AS created_on,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 730 END AS retention_until,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS INT) END AS overall_risk,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'unable_to_verify'
            WHEN floor(o_totalprice / 5000) <= 29 THEN 'verification_passed'
            WHEN floor(o_totalprice / 5000) <= 59 THEN 'review_recommended'
            ELSE 'manual_review_required' END AS recommendation
FROM orders"""),
    "b_members": ((), """
SELECT l_orderkey AS case_id, l_suppkey AS user_id,
       min(CASE WHEN l_returnflag = 'R' THEN 'editor' ELSE 'viewer' END) AS access
FROM lineitem GROUP BY ALL"""),
    "b_docs": ((), """
SELECT l_orderkey AS case_id,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(round(l_extendedprice * 100) AS BIGINT)) AS document_id,
       l_linenumber AS doc_ord,
       CASE l_partkey % 6 WHEN 0 THEN 'passport' WHEN 1 THEN 'national_id' WHEN 2 THEN 'pan'
            WHEN 3 THEN 'driving_licence' WHEN 4 THEN 'voter_id' ELSE 'address_proof' END AS document_type,
       60 + l_quantity * 0.8::DOUBLE AS confidence,
       'scan-' || l_linenumber || '-' || l_partkey || '.png' AS file_name,
       sha256(concat_ws('|', l_partkey, l_suppkey, CAST(l_quantity AS INT))) AS file_hash,
       l_partkey, l_suppkey, l_linestatus, l_returnflag, l_tax, l_discount, l_quantity,
       CAST(l_shipdate AS DATE) AS issue_d,
       CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber = 7 THEN -1 ELSE 3650 END AS expiry_d,
       DATE '1960-01-01' + CAST(l_orderkey % 15000 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS INT) AS dob_d,
       (l_orderkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) % (SELECT count(*) FROM part) AS name_key
FROM lineitem"""),
    "b_printed": (("b_docs",), """
SELECT d.*, p_name,
       CASE WHEN doc_ord = 3 THEN substring(p_name, 1, 1) || ' ' || split_part(p_name, ' ', -1)
            WHEN doc_ord % 2 = 0 THEN upper(p_name) ELSE p_name END AS full_name,
       CASE WHEN doc_ord % 2 = 0 THEN strftime(dob_d, '%d/%m/%Y') ELSE CAST(dob_d AS VARCHAR) END AS date_of_birth,
       CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN doc_ord <> 4 THEN l_returnflag END AS nationality,
       CASE document_type WHEN 'pan' THEN 'ABCP' || upper(substring(p_name, 1, 1)) ||
                                         lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') || 'F'
            WHEN 'passport' THEN 'SR' || lpad(CAST(l_partkey AS VARCHAR), 7, '0')
            ELSE CAST(l_partkey AS VARCHAR) END AS document_number,
       (case_id % 90 + 10) || ' ' || p_name || ' road ' ||
            CASE WHEN doc_ord = 2 THEN 'oo, eae' ELSE 'pune' END AS address
FROM b_docs d JOIN part ON p_partkey = name_key"""),
    "b_fields": (("b_printed",), """
SELECT case_id, document_id, document_type, file_name, doc_ord, confidence, field_name, value FROM (
 SELECT *, unnest(['full_name','date_of_birth','gender','nationality','document_number','address',
                   'issue_date','expiry_date']) AS field_name,
        unnest([full_name, date_of_birth, gender, nationality, document_number, address,
                CAST(issue_d AS VARCHAR), CAST(expiry_d AS VARCHAR)]) AS value
 FROM (SELECT case_id, document_id, document_type, file_name, doc_ord, confidence, full_name, date_of_birth,
              gender, nationality, document_number, address, issue_d, expiry_d FROM b_printed) q) t
WHERE value IS NOT NULL"""),
    "b_forensics": (("b_docs",), """
SELECT case_id, document_id, file_name,
       CASE WHEN l_suppkey % 2 = 0 THEN 'photo zone' ELSE 'text band' END AS region,
       CASE l_suppkey % 4 WHEN 0 THEN 'copy_move_anomaly' WHEN 1 THEN 'ela_compression_anomaly'
            WHEN 2 THEN 'noise_gradient_anomaly' ELSE 'metadata_tamper_indicator' END AS finding_type,
       score, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, round_even((l_partkey % 97) / 97.0::DOUBLE, 2) AS score FROM b_docs WHERE l_quantity <= 10) t"""),
    "b_reviews": (("b_cases", "b_members"), """
SELECT c.case_id AS review_id, c.case_id, m.assigned_to,
       CASE WHEN c.case_id % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, created_on + 30 AS due_on
FROM b_cases c JOIN (SELECT case_id, min(user_id) AS assigned_to FROM b_members GROUP BY 1) m USING (case_id)
WHERE c.status = 'under_review'"""),
    "b_audit": ((), """
SELECT event_id AS id, user_id AS actor_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS segment,
       event_type AS action, props AS details, ts AS created_at FROM events"""),
    "b_stages": ((), """
SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS case_id, event_id AS order_index,
       event_type AS stage_key, CAST(floor(value * 10) AS INT) AS duration_ms FROM events"""),
    "b_versions": ((), """
SELECT doc_id AS version_id, source || '/' || lang || '/' || (doc_id % 97) AS document_id,
       source || '/' || doc_id || '.txt' AS filename, lang, source, text, n_chars, sha256(text) AS sha256
FROM documents"""),
}


def with_tables(body: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``body`` after the WITH list of the tables it names, dependencies first."""
    known = {**TABLES, **(extra or {})}
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for parent in known[name][0]:
                need(parent)
            order.append(name)

    import re
    for name in re.findall(r"\b[bq]_\w+", body):
        if name in known:
            need(name)
    if not order:
        return body.strip()
    heads = ",\n".join(f"{name} AS ({known[name][1].strip()})" for name in order)
    return f"WITH {heads}\n{body.strip()}"

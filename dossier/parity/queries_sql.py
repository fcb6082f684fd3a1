"""SQL that DuckDB runs on the same tables; results must equal the queries of the same name."""
from __future__ import annotations

from dossier.parity.tables_sql import with_tables

KEY = b"dossier-example-key-0123456789ab"
AS_OF = "DATE '1998-06-30'"


def hmac(message: str) -> str:
    """HMAC-SHA-256 of a text expression."""
    pads = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
    inner = f"sha256(unhex('{pads[0]}') || encode({message}))"
    return f"sha256(unhex('{pads[1]}') || unhex({inner}))"


def name_agree(a: str, b: str) -> str:
    def subset(x: str, y: str) -> str:
        return (f"(len({x}) > 0 AND len(list_filter({x}, lambda s: len(list_filter({y}, lambda t: s = t OR "
                f"((length(s) = 1 OR length(t) = 1) AND s[1] = t[1]))) > 0)) = len({x}))")

    return f"({subset(a, b)} OR {subset(b, a)})"


def address_agree(a: str, b: str) -> str:
    return (f"(least(len({a}), len({b})) > 0 AND len(list_intersect({a}, {b})) / "
            f"greatest(1, least(len({a}), len({b}))) >= 0.7)")


def agree(field: str, a: str, b: str) -> str:
    """Two token lists of a name or address field."""
    return f"(CASE WHEN {field} = 'address' THEN {address_agree(a, b)} ELSE {name_agree(a, b)} END)"


NAME_TOKENS = "list_sort(list_distinct(list_filter(string_split(upper(strip_accents({0})), ' '), lambda w: w <> '')))"
ADDRESS_TOKENS = ("list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'),"
                  " ' '), lambda w: length(w) > 1)))")


def label(col: str, pairs: dict[str, str], fallback: str | None = None) -> str:
    cases = " ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in pairs.items())
    return f"CASE {col} {cases} ELSE {fallback or col} END"


FIELD_LABELS = {
    "full_name": "Name", "date_of_birth": "Date of Birth", "document_number": "Document Number", "gender": "Gender",
    "nationality": "Nationality", "issue_date": "Date of Issue", "expiry_date": "Date of Expiry",
    "address": "Address", "facial_photo": "Facial Photo",
}
PARSED = "coalesce(TRY_CAST({0} AS DATE), CAST(try_strptime({0}, '%d/%m/%Y') AS DATE))"
AGE = ("(year({1}) - year({0}) - CASE WHEN month({1}) * 100 + day({1}) < month({0}) * 100 + day({0}) "
       "THEN 1 ELSE 0 END)")

# ---- intermediate tables ------------------------------------------------------------------

STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "q_visits": (("b_cases", "b_members"), """
SELECT case_id, lead_user_id AS user_id FROM b_cases UNION SELECT case_id, user_id FROM b_members
UNION SELECT case_id, case_id % 150 FROM b_cases"""),
    "q_checks": (("b_printed",), f"""
SELECT case_id, document_id, check_type, status, message FROM (
 SELECT case_id, document_id, 'Document type recognized' AS check_type, 'pass' AS status,
        'Detected type: ' || replace(document_type, '_', ' ') || '.' AS message FROM b_printed
 UNION ALL
 SELECT case_id, document_id, 'Document number format',
        CASE WHEN document_type = 'address_proof' OR ok THEN 'pass' ELSE 'fail' END,
        CASE WHEN document_type = 'address_proof'
             THEN 'Document number present (''' || number || '''); no type-specific pattern defined.'
             WHEN ok THEN '''' || number || ''' matches the expected ' || document_type || ' pattern.'
             ELSE '''' || number || ''' does not match the expected ' || document_type || ' pattern.' END
 FROM (SELECT *, upper(trim(document_number)) AS number, CASE document_type
        WHEN 'passport' THEN regexp_full_match(document_number, '[A-Z]{{1,2}}[0-9]{{7,8}}')
        WHEN 'national_id' THEN regexp_full_match(document_number, '[A-Z]{{2}}-[0-9]{{4}}-[0-9]{{4}}')
        WHEN 'pan' THEN regexp_full_match(document_number, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')
        WHEN 'driving_licence' THEN regexp_full_match(document_number, '[A-Z]{{2}}[0-9]{{13,15}}')
        WHEN 'voter_id' THEN regexp_full_match(document_number, '[A-Z]{{3}}[0-9]{{7}}') END AS ok FROM b_printed)
 UNION ALL
 SELECT case_id, document_id,
        CASE WHEN doc_ord % 2 = 0 THEN 'Date of birth format' WHEN dob_d > {AS_OF} THEN 'Date of birth plausibility'
             ELSE 'Date of birth' END,
        CASE WHEN doc_ord % 2 = 0 OR dob_d > {AS_OF} THEN 'fail' ELSE 'pass' END,
        CASE WHEN doc_ord % 2 = 0 THEN 'Could not parse date of birth ''' || date_of_birth || '''.'
             WHEN dob_d > {AS_OF} THEN 'Date of birth ' || dob_d || ' is in the future.'
             ELSE 'Date of birth ' || dob_d || ' (age ' || {AGE.format('dob_d', AS_OF)} || ').' END FROM b_printed
 UNION ALL
 SELECT case_id, document_id, CASE WHEN expiry_d <= issue_d THEN 'Issue/expiry logic' ELSE 'Issue/DOB logic' END,
        'fail', CASE WHEN expiry_d <= issue_d
             THEN 'Expiry ' || expiry_d || ' precedes issue date ' || issue_d || '.'
             ELSE 'Issue date ' || issue_d || ' precedes date of birth.' END
 FROM b_printed WHERE expiry_d <= issue_d OR (doc_ord % 2 = 1 AND issue_d < dob_d)
 UNION ALL
 SELECT case_id, document_id, 'Expiration status', CASE WHEN expiry_d < {AS_OF} THEN 'warning' ELSE 'pass' END,
        CASE WHEN expiry_d < {AS_OF} THEN 'Document expired on ' ELSE 'Valid until ' END || expiry_d || '.'
 FROM b_printed
 UNION ALL
 SELECT case_id, document_id, 'Mandatory fields',
        CASE WHEN document_type = 'passport' AND nationality IS NULL THEN 'fail' ELSE 'pass' END,
        CASE WHEN document_type = 'passport' AND nationality IS NULL
             THEN 'Missing required field(s): nationality.' ELSE 'All required fields are present.' END
 FROM b_printed) t"""),
    "q_qr": (("b_printed",), f"""
SELECT case_id, document_id, doc_ord, check_type, status, message, coded FROM (
 SELECT case_id, document_id, doc_ord, 'QR payload vs document number' AS check_type,
        CASE WHEN l_tax < 0.02 THEN 'fail' ELSE 'pass' END AS status,
        CASE WHEN l_tax < 0.02 THEN 'QR/document mismatch: QR encodes X' || document_number ||
                  ' but the printed number reads ' || document_number || '.'
             ELSE 'QR-encoded document number matches the printed value (' || document_number || ').' END AS message,
        CASE WHEN l_tax < 0.02 THEN 'X' ELSE '' END || document_number AS coded FROM b_printed p1
  WHERE doc_ord % 3 <> 0 AND doc_ord <> 5
 UNION ALL
 SELECT case_id, document_id, doc_ord, 'QR payload vs name', 'pass',
        'Name on QR payload is consistent with the printed name.', upper(p_name)
 FROM b_printed p2 WHERE doc_ord % 3 <> 0 AND doc_ord <> 5
 UNION ALL
 SELECT case_id, document_id, doc_ord, 'QR payload vs date of birth',
        CASE WHEN l_discount > 0.08 THEN 'fail' ELSE 'pass' END,
        CASE WHEN l_discount > 0.08 THEN 'QR/DOB mismatch: QR encodes ' || strftime(dob_d + 1, '%d/%m/%Y') ||
                  ' but printed reads ''' || date_of_birth || '''.'
             ELSE 'Date of Birth on QR payload matches printed DOB (' || date_of_birth || ').' END,
        strftime(dob_d + CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END, '%d/%m/%Y')
 FROM b_printed p3 WHERE doc_ord % 3 <> 0 AND doc_ord <> 5) t"""),
    "q_reuse": (("b_docs",), """
SELECT d.case_id, d.document_id, copies - 1 AS hits,
       CASE WHEN d.document_id = first_id THEN last_id ELSE first_id END AS other_document_id,
       CASE WHEN d.document_id = first_id THEN last_case ELSE first_case END AS other_case_id
FROM b_docs d JOIN (SELECT file_hash, count(*) AS copies, min(document_id) AS first_id, max(document_id) AS last_id,
                           arg_min(case_id, document_id) AS first_case, arg_max(case_id, document_id) AS last_case
                    FROM b_docs GROUP BY 1 HAVING count(*) > 1) g USING (file_hash)"""),
    "q_reuse_rows": (("q_reuse",), """
SELECT case_id, document_id, 'Duplicate / reuse' AS check_type, 'warning' AS status,
       'Potential reuse detected — this document appears identical file (case #' || other_case_id || ')' ||
       CASE WHEN hits > 1 THEN ' and ' || (hits - 1) || ' more match(es).' ELSE '.' END AS message FROM q_reuse"""),
    # a birth after the day of the screening is read as one a century earlier
    "q_zones": (("b_printed",), f"""
SELECT *, CASE WHEN year(dob_d) > year({AS_OF}) THEN CAST(TRY_CAST((year(dob_d) - 100) || strftime(dob_d, '-%m-%d') AS DATE) AS VARCHAR)
       ELSE CAST(dob_d AS VARCHAR) END AS zone_dob FROM b_printed WHERE document_type = 'passport'"""),
    "q_mrz": (("q_zones",), """
SELECT case_id, document_id, doc_ord, check_type, status, message, coded FROM (
 SELECT case_id, document_id, doc_ord, 'MRZ checksum' AS check_type, CASE WHEN l_tax < 0.02 THEN 'fail' ELSE 'pass' END AS status,
        CASE WHEN l_tax < 0.02 THEN 'MRZ check digit failure(s): document_number.'
             ELSE 'All MRZ check digits are structurally valid.' END AS message, CAST(NULL AS VARCHAR) AS coded
 FROM q_zones p1
 UNION ALL SELECT case_id, document_id, doc_ord, 'MRZ vs printed document number', 'pass',
        'Document number matches MRZ (' || document_number || ').', document_number FROM q_zones p2
 UNION ALL SELECT case_id, document_id, doc_ord, 'MRZ vs printed date of birth', CASE WHEN date_of_birth = zone_dob THEN 'pass' ELSE 'fail' END,
        CASE WHEN date_of_birth = zone_dob THEN 'Date of birth matches MRZ (' || zone_dob || ').'
             ELSE 'Mismatch: printed ' || date_of_birth || ' vs MRZ ' || zone_dob || '.' END, zone_dob
 FROM q_zones p3 WHERE zone_dob IS NOT NULL
 UNION ALL SELECT case_id, document_id, doc_ord, 'MRZ vs printed name', 'pass', 'Name consistent with MRZ (' || upper(p_name) || ').',
        upper(p_name) FROM q_zones p4) t"""),
    "q_validations": (("q_checks", "q_qr", "q_mrz", "q_reuse_rows"), """
SELECT * FROM q_checks UNION ALL SELECT case_id, document_id, check_type, status, message FROM q_qr
UNION ALL SELECT case_id, document_id, check_type, status, message FROM q_mrz
UNION ALL SELECT * FROM q_reuse_rows"""),
    "q_status": (("b_docs", "b_fields", "q_validations"), """
SELECT case_id, document_id, document_type, coalesce(n_fields, 0) AS n_fields, passed, failed, warned,
       CASE WHEN coalesce(n_fields, 0) = 0 AND passed = 0 THEN 'unable_to_verify'
            WHEN failed + warned > 0 THEN 'review_required' ELSE 'valid' END AS status
FROM (SELECT d.case_id, d.document_id, d.document_type, f.n_fields, coalesce(passed, 0) AS passed,
             coalesce(failed, 0) AS failed, coalesce(warned, 0) AS warned
      FROM b_docs d LEFT JOIN (SELECT document_id, count(*) FILTER (status = 'pass') AS passed,
             count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warning') AS warned
             FROM q_validations GROUP BY 1) v USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS n_fields FROM b_fields GROUP BY 1) f USING (document_id)) t"""),
    # distinct values per case, field and type with their tokens
    "q_values": (("b_fields",), f"""
SELECT case_id, field_name, type_key, form, any_value(toks) AS toks, count(*) AS n,
       min({{'o': doc_ord, 'd': document_id, 'v': value}}) AS pos
FROM (SELECT case_id, field_name, doc_ord, document_id, value,
        CASE WHEN field_name IN ('document_number', 'issue_date', 'expiry_date') THEN document_type ELSE '' END
          AS type_key,
        CASE WHEN field_name = 'full_name' THEN {NAME_TOKENS.format('value')}
             WHEN field_name = 'address' THEN {ADDRESS_TOKENS.format('value')} END AS toks,
        CASE WHEN field_name = 'full_name' THEN array_to_string({NAME_TOKENS.format('value')}, ' ')
             WHEN field_name = 'address' THEN array_to_string({ADDRESS_TOKENS.format('value')}, ' ')
             WHEN field_name IN ('date_of_birth', 'issue_date', 'expiry_date')
               THEN CAST({PARSED.format('value')} AS VARCHAR)
             ELSE upper(trim(value)) END AS form FROM b_fields) t
GROUP BY 1, 2, 3, 4"""),
}


def leaders(source: str, prefix: str, keys: str, rounds: int = 4) -> dict[str, tuple[tuple[str, ...], str]]:
    """Greedy clusters of the fuzzy fields of ``source``: one leader per step, unrolled.

    A value that is left after the last step would break the count on purpose.
    """
    steps: dict[str, tuple[tuple[str, ...], str]] = {}
    rest = source
    for i in range(1, rounds + 1):
        steps[f"{prefix}l{i}"] = ((rest,), (
            f"SELECT {keys}, min(pos) AS lead, arg_min(toks, pos) AS lead_toks, arg_min(form, pos) AS lead_form "
            f"FROM {rest} WHERE field_name IN ('full_name', 'address') GROUP BY {keys}"))
        steps[f"{prefix}a{i}"] = ((rest, f"{prefix}l{i}"), (
            f"SELECT v.*, l.lead, l.lead_form, {agree('v.field_name', 'l.lead_toks', 'v.toks')} AS ok "
            f"FROM {rest} v JOIN {prefix}l{i} l USING ({keys})"))
        steps[f"{prefix}r{i}"] = ((f"{prefix}a{i}",), f"SELECT * EXCLUDE (lead, lead_form, ok) FROM {prefix}a{i} WHERE NOT ok")
        rest = f"{prefix}r{i}"
    parts = " UNION ALL ".join(
        f"SELECT {keys}, form, n, pos, lead, lead_form FROM {prefix}a{i} WHERE ok" for i in range(1, rounds + 1))
    steps[f"{prefix}clusters"] = (
        (source, *[f"{prefix}a{i}" for i in range(1, rounds + 1)], f"{prefix}r{rounds}"),
        f"{parts} UNION ALL SELECT {keys}, form, n, pos, pos, form || '?' FROM {prefix}r{rounds} "
        f"UNION ALL SELECT {keys}, form, n, pos, pos, form FROM {source} "
        f"WHERE field_name NOT IN ('full_name', 'address')")
    return steps


STEPS.update(leaders("q_values", "q_v", "case_id, field_name, type_key"))
_SEVERITY = ("CASE WHEN field_name IN ('full_name', 'date_of_birth', 'document_number') THEN 'high' ELSE 'medium' END")
_LABEL = label("field_name", FIELD_LABELS)
STEPS["q_findings"] = (("q_vclusters",), f"""
SELECT case_id, field_name, type_key, CASE WHEN n_clusters = 1 THEN 'info' ELSE {_SEVERITY} END AS severity,
       n_documents, n_clusters,
       CASE WHEN n_clusters > 1 THEN {_LABEL} || ' differs across submitted documents.'
            WHEN type_key <> '' THEN {_LABEL} || ' is consistent across the ' || n_documents || ' ' ||
                 replace(type_key, '_', ' ') || ' document(s).'
            ELSE {_LABEL} || ' is consistent across all ' || n_documents || ' documents.' END AS explanation
FROM (SELECT case_id, field_name, type_key, CAST(sum(n) AS BIGINT) AS n_documents,
             count(DISTINCT lead_form) AS n_clusters FROM q_vclusters GROUP BY 1, 2, 3) t WHERE n_documents >= 2""")
STEPS["q_age"] = (("b_docs",), f"""
SELECT c.case_id, v.case_id IS NOT NULL AS bad, v.age, v.file_name, v.document_type
FROM (SELECT case_id, arg_min(dob_d, (doc_ord, document_id)) AS born FROM b_docs GROUP BY 1) c
LEFT JOIN (SELECT d.case_id, min({{'o': doc_ord, 'd': document_id}}) AS pos,
                  arg_min({AGE.format('born', 'issue_d')}, (doc_ord, document_id)) AS age,
                  arg_min(file_name, (doc_ord, document_id)) AS file_name,
                  arg_min(document_type, (doc_ord, document_id)) AS document_type
           FROM b_docs d JOIN (SELECT case_id, arg_min(dob_d, (doc_ord, document_id)) AS born FROM b_docs GROUP BY 1)
                b USING (case_id)
           WHERE document_type IN ('driving_licence', 'voter_id') AND {AGE.format('born', 'issue_d')} < 18
           GROUP BY 1) v USING (case_id)""")
STEPS["q_rule_age"] = (("q_age",), """
SELECT case_id, 'RULE-AGE-001' AS rule_id, CASE WHEN bad THEN 'fail' ELSE 'pass' END AS status,
       CASE WHEN bad THEN 'high' ELSE 'info' END AS severity,
       CASE WHEN bad THEN 'Applicant was only ' || age || ' years old at the issuance of ' || file_name || ' (' ||
            CASE document_type WHEN 'driving_licence' THEN 'Driving Licence' ELSE 'Voter Id' END ||
            '), violating statutory minimum age requirement (18+).'
            ELSE 'Applicant age at issuance meets or exceeds regulatory minimum requirements (18+).' END AS explanation
FROM q_age""")
STEPS["q_date_issues"] = (("b_docs",), f"""
SELECT case_id, document_id, doc_ord, 1 AS issue_no,
       file_name || ': Date of birth (' || dob_d || ') is in the future.' AS issue FROM b_docs WHERE dob_d > {AS_OF}
UNION ALL SELECT case_id, document_id, doc_ord, 2, file_name || ': Issue date (' || issue_d || ') is in the future.'
FROM b_docs WHERE issue_d > {AS_OF}
UNION ALL SELECT case_id, document_id, doc_ord, 3, file_name || ': Expiration date (' || expiry_d ||
       ') precedes or equals issue date (' || issue_d || ').' FROM b_docs WHERE expiry_d <= issue_d""")
STEPS["q_rule_dates"] = (("b_docs", "q_date_issues"), """
SELECT case_id, 'RULE-CHRONO-001' AS rule_id, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status,
       CASE WHEN n > 0 THEN 'high' ELSE 'info' END AS severity,
       CASE WHEN n > 0 THEN 'Chronological inconsistencies detected: ' || first ||
            CASE WHEN n > 1 THEN ' and ' || (n - 1) || ' more' ELSE '' END
            ELSE 'All dates (birth, issuance, expiration) conform to a valid chronological sequence.' END AS explanation
FROM (SELECT DISTINCT case_id FROM b_docs) c LEFT JOIN
     (SELECT case_id, count(*) AS n, arg_min(issue, (doc_ord, document_id, issue_no)) AS first
      FROM q_date_issues GROUP BY 1) i USING (case_id)""")
STEPS["q_rule_pan"] = (("b_printed",), """
SELECT case_id, 'RULE-PAN-001' AS rule_id,
       CASE WHEN pan IS NULL THEN 'not_applicable' WHEN surname[1] = pan[5] THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN pan IS NULL OR surname[1] = pan[5] THEN 'info' ELSE 'high' END AS severity,
       CASE WHEN pan IS NULL THEN 'No PAN card available to evaluate 5th-character surname checksum.'
            WHEN surname[1] = pan[5] THEN 'PAN 5th character ''' || pan[5] ||
                 ''' matches the first letter of surname ''' || surname || '''.'
            ELSE 'PAN 5th character ''' || pan[5] || ''' does not match applicant surname ''' || surname ||
                 ''' (expected initial ''' || pan[5] || ''', but found ''' || surname[1] || ''').' END AS explanation
FROM (SELECT case_id, arg_min(document_number, (doc_ord, document_id)) FILTER (document_type = 'pan') AS pan,
             arg_min(upper(split_part(full_name, ' ', -1)), (doc_ord, document_id)) AS surname
      FROM b_printed GROUP BY 1) t""")
STEPS["q_rule_rows"] = (("q_rule_age", "q_rule_dates", "q_rule_pan"), """
SELECT case_id, rule_id AS field_name, '' AS type_key, severity, CAST(0 AS BIGINT) AS n_documents,
       CAST(0 AS BIGINT) AS n_clusters, explanation
FROM (SELECT * FROM q_rule_age UNION ALL SELECT * FROM q_rule_dates UNION ALL SELECT * FROM q_rule_pan) r
WHERE status IN ('fail', 'warning')""")
STEPS["q_pairs"] = ((), """
SELECT case_id, least(100, greatest(0, round_even(c * 100, 0)))::INT AS score FROM (
 SELECT a.vec_id // 8 AS case_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) *
        list_dot_product(b.e, b.e)) AS c
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e
       FROM embeddings) b ON a.vec_id // 8 = b.vec_id // 8 AND a.vec_id < b.vec_id) t""")
STEPS["q_matched"] = (("q_pairs",), """
SELECT case_id, n_vectors, coalesce(matches, 0) AS matches, coalesce(borderlines, 0) AS borderlines,
       coalesce(mismatches, 0) AS mismatches, CASE WHEN n_vectors = 1 THEN 'single_face' WHEN mismatches > 0 THEN 'mismatch'
       WHEN borderlines > 0 THEN 'borderline' ELSE 'match' END AS status
FROM (SELECT vec_id // 8 AS case_id, count(*) AS n_vectors FROM embeddings GROUP BY 1) v
LEFT JOIN (SELECT case_id, count(*) FILTER (score >= 35) AS matches, count(*) FILTER (score >= 20 AND score < 35) AS
  borderlines, count(*) FILTER (score < 20) AS mismatches FROM q_pairs GROUP BY 1) p USING (case_id)""")
STEPS["q_face_findings"] = (("q_matched",), """
SELECT case_id, 'facial_photo' AS field_name, 'high' AS severity, mismatches AS pairs FROM q_matched WHERE mismatches > 0
UNION ALL SELECT case_id, 'facial_photo', 'medium', borderlines FROM q_matched WHERE borderlines > 0
UNION ALL SELECT case_id, 'facial_photo', 'info', matches FROM q_matched WHERE matches > 0""")
STEPS["q_face_rows"] = (("q_face_findings", "b_cases"), """
SELECT case_id, field_name, '' AS type_key, severity, CAST(0 AS BIGINT) AS n_documents, CAST(0 AS BIGINT) AS n_clusters,
       CASE severity WHEN 'high' THEN 'Photos show different people' WHEN 'medium' THEN
         'Photos are too unlike to be sure of one person' ELSE 'Photos show the same person' END || ' in ' || pairs ||
       ' pair(s) of documents.' AS explanation, pairs
FROM q_face_findings WHERE case_id IN (SELECT case_id FROM b_cases)""")
STEPS["q_all_findings"] = (("q_findings", "q_rule_rows", "q_face_rows"), """
SELECT *, CAST(1 AS BIGINT) AS pairs FROM q_findings UNION ALL SELECT *, 1 FROM q_rule_rows UNION ALL SELECT * FROM q_face_rows""")
_F = ("sum(CASE WHEN severity IN ('medium', 'high') AND field_name IN ({0}) THEN pairs ELSE 0 END)")
STEPS["q_evidence"] = (("b_cases", "b_docs", "b_fields", "b_forensics", "q_all_findings", "q_validations"), f"""
SELECT c.case_id, coalesce(address_mismatch, 0)::BIGINT AS address_mismatch, coalesce(dob_mismatch, 0)::BIGINT AS
       dob_mismatch, coalesce(document_number_mismatch, 0)::BIGINT AS document_number_mismatch,
       coalesce(face_mismatch, 0)::BIGINT AS face_mismatch, coalesce(gender_nationality_mismatch, 0)::BIGINT AS gender_nationality_mismatch,
       coalesce(name_mismatch, 0)::BIGINT AS name_mismatch, coalesce(fh, 0)::BIGINT AS forensic_high,
       coalesce(fm, 0)::BIGINT AS forensic_medium, coalesce(vf, 0)::BIGINT AS validation_fail,
       coalesce(ve, 0)::BIGINT AS expired, coalesce(zf, 0)::BIGINT AS mrz_fail, coalesce(zp, 0)::BIGINT AS mrz_pass,
       coalesce(vr, 0)::BIGINT AS reuse_hits, coalesce(name_info, 0)::BIGINT AS name_info,
       coalesce(address_info, 0)::BIGINT AS address_info, coalesce(face_info, 0)::BIGINT AS face_info, coalesce(vn, 0)::BIGINT AS checks,
       coalesce(vok, 0)::BIGINT AS checks_ok, coalesce(nf, 0)::BIGINT AS n_fields, coalesce(nr, 0)::BIGINT AS n_read,
       coalesce(nd, 0)::BIGINT AS n_docs
FROM b_cases c
LEFT JOIN (SELECT case_id, {_F.format("'address'")} AS address_mismatch,
                  {_F.format("'date_of_birth', 'RULE-AGE-001'")} AS dob_mismatch,
                  {_F.format("'document_number', 'RULE-CHRONO-001'")} AS document_number_mismatch,
                  {_F.format("'gender', 'nationality'")} AS gender_nationality_mismatch,
                  {_F.format("'facial_photo'")} AS face_mismatch,
                  count(*) FILTER (severity = 'info' AND field_name = 'facial_photo') AS face_info,
                  {_F.format("'full_name', 'RULE-PAN-001'")} AS name_mismatch,
                  count(*) FILTER (severity = 'info' AND field_name = 'full_name') AS name_info,
                  count(*) FILTER (severity = 'info' AND field_name = 'address') AS address_info
           FROM q_all_findings GROUP BY 1) f USING (case_id)
LEFT JOIN (SELECT case_id, count(*) FILTER (severity = 'high') AS fh, count(*) FILTER (severity = 'medium') AS fm
           FROM b_forensics GROUP BY 1) x USING (case_id)
LEFT JOIN (SELECT case_id, count(*) FILTER (status = 'fail') AS vf,
                  count(*) FILTER (check_type = 'Expiration status' AND status = 'warning') AS ve,
                  count(*) FILTER (check_type = 'MRZ checksum' AND status = 'fail') AS zf,
                  count(*) FILTER (check_type = 'MRZ checksum' AND status = 'pass') AS zp,
                  count(*) FILTER (check_type = 'Duplicate / reuse') AS vr, count(*) AS vn,
                  count(*) FILTER (status IN ('pass', 'unavailable')) AS vok
           FROM q_validations GROUP BY 1) v USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS nf FROM b_fields GROUP BY 1) n USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS nd, count(*) FILTER (l_linestatus = 'F') AS nr FROM b_docs GROUP BY 1) d
     USING (case_id)""")

_FACTORS = [  # factor, occurrences, cap, weight, words
    ("dob_mismatch", "dob_mismatch", None, 30, "Cross-document conflict detected in date of birth."),
    ("name_mismatch", "name_mismatch", None, 30, "Cross-document conflict detected in full name."),
    ("document_number_mismatch", "document_number_mismatch", None, 25,
     "Cross-document conflict detected in document number."),
    ("address_mismatch", "address_mismatch", None, 15, "Cross-document conflict detected in address."),
    ("gender_nationality_mismatch", "gender_nationality_mismatch", None, 15,
     "Cross-document conflict detected in gender or nationality."),
    ("face_mismatch", "face_mismatch", None, 35, "Cross-document conflict detected in facial photo."),
    ("forensic_high", "forensic_high", 1, 25, "High-suspicion visual tampering indicator(s)."),
    ("forensic_medium", "forensic_medium", 2, 12, "Visual tampering indicator(s) detected."),
    ("validation_fail_per_check", "validation_fail", 18, 6, "Structural/logical validation check(s) failed."),
    ("expired_document", "least(expired, 1)", 1, 10, "At least one submitted document is expired."),
    ("mrz_checksum_fail", "least(mrz_fail, 1)", 1, 20, "MRZ checksum verification failed."),
    ("document_reuse", "least(reuse_hits, 1)", 1, 30, "This identity evidence was reused across submissions"),
]
_GATE = ("face_mismatch + dob_mismatch + name_mismatch + document_number_mismatch + address_mismatch + gender_nationality_mismatch"
         " + forensic_high + reuse_hits = 0")
_CUTS = [
    ("name_consistent", "name_info > 0", "Name consistent across documents."),
    ("address_consistent", "address_info > 0", "Address consistent across documents."),
    ("face_matched", "face_info > 0", "Facial photo consistent across documents."),
    ("mrz_valid", "mrz_pass > 0", "MRZ checksums verified successfully."),
    ("all_validations_pass", "checks > 0 AND checks = checks_ok", "All document validation checks passed."),
]


def _factor(name: str, n: str, cap: int | None, weight: int, words: str) -> str:
    used = f"least({n}, {cap})" if cap else n
    if name == "document_reuse":
        words += " (' || reuse_hits || ' match(es) found)."
    return (f"SELECT case_id, '{name}' AS factor, CAST({n} AS BIGINT) AS occurrences, CAST({used} AS BIGINT) AS applied,"
            f" CAST({used} * {weight} AS BIGINT) AS score, 'increase' AS direction, '{words}' || CASE WHEN {n} > {used} "
            f"THEN ' (' || {n} || ' occurrences, capped at ' || {used} || ')' WHEN {used} > 1 THEN ' (' || {used} || "
            f"' occurrences)' ELSE '' END AS explanation FROM q_evidence WHERE {n} > 0")


STEPS["q_ledger"] = (("q_evidence",), " UNION ALL ".join(
    [_factor(*f) for f in _FACTORS]
    + [f"SELECT case_id, '{name}', 1, 1, -5, 'decrease', '{words}' FROM q_evidence WHERE {_GATE} AND {when}"
       for name, when, words in _CUTS]))
_BAND = "CASE WHEN {0} <= 29 THEN 'LOW' WHEN {0} <= 59 THEN 'MEDIUM' WHEN {0} <= 79 THEN 'HIGH' ELSE 'CRITICAL' END"


def judged(requests: str) -> str:
    """Requests with what decides about them; ``requests`` selects case_id, user_id and more."""
    return f"""(SELECT r.*, u.role, u.active, c.lead_user_id, c.status, c.legal_hold, m.access,
  coalesce(c.lead_user_id = r.user_id, false) AS is_lead,
  c.case_id IS NOT NULL AND (coalesce(u.role, '') IN ('admin', 'auditor') OR coalesce(c.lead_user_id = r.user_id, false)
    OR m.access IS NOT NULL) AS sees,
  coalesce(u.role, '') <> 'auditor' AND (coalesce(u.role, '') = 'admin' OR coalesce(c.lead_user_id = r.user_id, false)
    OR coalesce(m.access = 'editor', false)) AS may_edit,
  coalesce(u.role, '') = 'admin' OR coalesce(c.lead_user_id = r.user_id, false) AS commands
 FROM ({requests}) r LEFT JOIN b_users u USING (user_id) LEFT JOIN b_cases c USING (case_id)
 LEFT JOIN b_members m ON m.case_id = r.case_id AND m.user_id = r.user_id)"""


def _someone(every: int) -> str:
    return f"CASE WHEN case_id % {every} = 0 THEN case_id % 150 ELSE lead_user_id END"


GATE = "CASE WHEN NOT sees THEN '404' WHEN NOT may_edit THEN '403' WHEN status = 'archived' THEN '409' END"

SQL: dict[str, str] = {}

# ---- scans, sources, sinks -------------------------------------------------------------------
SQL["table_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations".split())
SQL["intake_check"] = """
SELECT doc_id, source || '-' || doc_id || suffix AS filename,
       CASE suffix WHEN '.pdf' THEN 'application/pdf' WHEN '.TXT' THEN 'text/plain' END AS mime,
       CASE WHEN doc_id % 13 = 0 THEN 0 ELSE strlen(text) END AS byte_size, reason = '' AS accepted, reason
FROM (SELECT *, CASE WHEN suffix = '.exe' THEN 'unsupported type' WHEN doc_id % 13 = 0 OR strlen(text) = 0 OR
             strlen(text) > 26214400 THEN 'size out of bounds' WHEN suffix = '.pdf' AND left(text, 5) <> '%PDF-'
             THEN 'content does not match extension' ELSE '' END AS reason
      FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '.pdf' WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.TXT' END AS suffix
            FROM documents) d) t"""
SQL["screen_upload"] = """
SELECT doc_id, source || '_' || doc_id || suffix AS safe_name, reason = '' AS accepted, reason
FROM (SELECT *, CASE WHEN suffix = '.txt' THEN 'unsupported type'
             WHEN mime = 'image/png' AND suffix = '.pdf' OR mime = 'application/pdf' AND suffix = '.PNG'
             THEN 'type does not match extension' WHEN size <= 0 THEN 'empty' WHEN size > 26214400 THEN 'too large'
             ELSE '' END AS reason
      FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' ELSE '.txt' END AS suffix,
                   CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'image/png' ELSE 'application/pdf' END AS mime,
                   CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS size FROM documents) d) t"""
SQL["html_text"] = r"""
SELECT page_id, text, CASE WHEN text = '' THEN 'no_text' ELSE 'extracted' END AS extraction_status FROM (
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '\s+', ' ', 'g')) AS text FROM pages) t"""
SQL["content_fingerprint"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
SQL["payload_parse"] = "SELECT event_id, CAST(CAST(props AS JSON)->>'k' AS BIGINT) AS k FROM events"
SQL["audit_csv_lines"] = """
SELECT '"' || id || '","' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '","' || coalesce(name, 'System') || '","' ||
       action || '","' || segment || '","","' || sha256(details) || '"' AS line
FROM b_audit LEFT JOIN b_users ON user_id = actor_id"""
SQL["version_numbers"] = """
SELECT version_id, document_id, coalesce(stored, 0) + row_number() OVER (PARTITION BY document_id ORDER BY version_id)
       AS number
FROM b_versions LEFT JOIN (SELECT document_id, count(*) AS stored FROM b_versions WHERE version_id % 2 = 1 GROUP BY 1) s
     USING (document_id) WHERE version_id % 2 = 0"""

# ---- access ------------------------------------------------------------------------------------
GRANTS = """
SELECT user_id, 'all' AS scope, CAST(NULL AS BIGINT) AS case_id FROM b_users WHERE role IN ('admin', 'auditor')
UNION ALL SELECT user_id, 'case', case_id FROM (
  SELECT lead_user_id AS user_id, case_id FROM b_cases UNION SELECT user_id, case_id FROM b_members) t
WHERE user_id IN (SELECT user_id FROM b_users WHERE role NOT IN ('admin', 'auditor'))"""
SQL["visible_cases"] = f"SELECT user_id, scope, coalesce(CAST(case_id AS VARCHAR), '*') AS case_id FROM ({GRANTS}) g"
SQL["edit_rights"] = f"""
SELECT case_id, user_id, sees, sees AND may_edit AND status <> 'archived' AS can_edit,
       sees AND commands AND status = 'archived' AS can_reopen, coalesce({GATE}, 'ok') AS verdict
FROM {judged('SELECT * FROM q_visits')} j"""
SQL["archival_gate"] = f"""
SELECT case_id, user_id, CASE WHEN NOT sees THEN '404' WHEN NOT may_edit THEN '403'
  WHEN status = 'archived' AND NOT (coalesce(new_status = 'active' AND new_hold IS NULL AND NOT other_change, false)
       AND commands) THEN '409'
  WHEN new_hold IS NOT NULL AND NOT commands THEN '403'
  WHEN new_status = 'archived' AND coalesce(new_hold, legal_hold) THEN '409' ELSE 'ok' END AS verdict
FROM {judged(f'''SELECT case_id, {_someone(4)} AS user_id,
  CASE case_id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' END AS new_status,
  CASE case_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS new_hold, case_id % 7 = 0 AS other_change
  FROM b_cases''')} j"""
SQL["member_gate"] = f"""
SELECT j.case_id, j.user_id, j.target_id, CASE WHEN {GATE} IS NOT NULL THEN {GATE} WHEN NOT commands THEN '403'
  WHEN adding AND NOT coalesce(t.active, false) THEN '404'
  WHEN adding AND t.role = 'auditor' AND new_access = 'editor' THEN '422'
  WHEN NOT adding AND target_id = lead_user_id THEN '409'
  WHEN NOT adding AND h.case_id IS NULL THEN '404' ELSE 'ok' END AS verdict
FROM {judged(f'''SELECT case_id, {_someone(4)} AS user_id,
  CASE WHEN case_id % 10 = 0 THEN lead_user_id ELSE case_id * 3 % 150 END AS target_id,
  case_id % 2 = 0 AS adding, CASE WHEN case_id % 3 = 0 THEN 'viewer' ELSE 'editor' END AS new_access
  FROM b_cases''')} j LEFT JOIN b_users t ON t.user_id = target_id
LEFT JOIN b_members h ON h.case_id = j.case_id AND h.user_id = j.target_id"""
SQL["review_request_gate"] = f"""
SELECT j.case_id, j.user_id, j.assigned_to, CASE WHEN {GATE} IS NOT NULL THEN {GATE}
  WHEN NOT coalesce(t.active, false) OR NOT (t.role IN ('admin', 'auditor') OR lead_user_id = t.user_id OR
       h.case_id IS NOT NULL) THEN '422' ELSE 'ok' END AS verdict
FROM {judged(f'''SELECT case_id, {_someone(5)} AS user_id,
  CASE WHEN case_id % 2 = 0 THEN case_id * 5 % 150 ELSE lead_user_id END AS assigned_to FROM b_cases''')} j
LEFT JOIN b_users t ON t.user_id = assigned_to
LEFT JOIN b_members h ON h.case_id = j.case_id AND h.user_id = j.assigned_to"""
DECIDED = f"""(SELECT *, CASE WHEN NOT sees THEN '404' WHEN status = 'archived' THEN '409'
  WHEN assigned_to <> user_id AND role <> 'admin' THEN '403' WHEN review_status <> 'pending' THEN '409'
  ELSE 'ok' END AS verdict
 FROM {judged('''SELECT review_id, case_id, assigned_to, status AS review_status,
  CASE WHEN review_id % 6 = 0 THEN review_id % 150 ELSE assigned_to END AS user_id,
  CASE WHEN review_id % 4 = 0 THEN 'approved' ELSE 'rejected' END AS decision FROM b_reviews''')} j)"""
AFTER = "CASE WHEN verdict = 'ok' THEN CASE WHEN decision = 'approved' THEN 'closed' ELSE 'active' END END"
SQL["review_gate"] = f"SELECT review_id, case_id, user_id, verdict, {AFTER} AS case_status FROM {DECIDED} d"
SQL["reviewed_cases"] = f"""
SELECT coalesce(d.after, c.status) AS status, count(*) AS cases
FROM b_cases c LEFT JOIN (SELECT case_id, {AFTER} AS after FROM {DECIDED} d WHERE verdict = 'ok') d USING (case_id)
GROUP BY 1"""
SQL["review_queue"] = f"""
SELECT assigned_to, coalesce(name, 'Unknown') AS assigned_name, pending, due, first_due
FROM (SELECT assigned_to, count(*) AS pending, count(*) FILTER (due_on <= {AS_OF}) AS due,
             CAST(min(due_on) AS VARCHAR) AS first_due FROM b_reviews WHERE status = 'pending' GROUP BY 1) r
LEFT JOIN b_users ON user_id = assigned_to"""
SQL["retention_due"] = f"""
SELECT case_id, reference, CAST(retention_until AS VARCHAR) AS retention_until FROM b_cases
WHERE retention_until <= {AS_OF} AND NOT legal_hold AND status <> 'archived'"""
SQL["account_checks"] = """
SELECT c_custkey AS user_id, c_custkey % 9 <> 0 AS email_ok, length(c_name) BETWEEN 2 AND 160 AS name_ok,
       regexp_matches(c_mktsegment, '^[A-Za-z0-9][A-Za-z0-9/._-]*$') AS reference_ok FROM customer"""

# ---- listings ---------------------------------------------------------------------------------------
SQL["case_search"] = """
SELECT case_id, reference, title, status FROM b_cases WHERE status = 'active' AND
 (reference ILIKE '%urgent%' OR title ILIKE '%urgent%' OR description ILIKE '%urgent%')"""
SQL["case_search_wildcards"] = """
SELECT case_id, reference FROM b_cases WHERE reference ILIKE '%case/1_%9%' OR title ILIKE '%case/1_%9%'
 OR description ILIKE '%case/1_%9%'"""
SQL["recent_cases"] = """
SELECT case_id, reference, status, CAST(created_on AS VARCHAR) AS created_on FROM b_cases
ORDER BY created_on DESC, case_id DESC LIMIT 100"""
SQL["documents_of_kind"] = """
SELECT case_id, count(*) AS documents FROM b_docs WHERE document_type = 'voter_id' GROUP BY 1"""
SQL["recent_documents"] = """
SELECT document_id, case_id, document_type, CAST(issue_d AS VARCHAR) AS issue_d FROM b_docs
ORDER BY b_docs.issue_d DESC, document_id DESC LIMIT 200"""
SQL["recent_audit"] = """
SELECT id, case_id, action, coalesce(name, 'System') AS actor_name FROM (
 SELECT id, CAST(segment AS BIGINT) AS case_id, action, actor_id FROM b_audit WHERE segment IN (
   SELECT case_id FROM b_cases WHERE lead_user_id = 5 UNION SELECT case_id FROM b_members WHERE user_id = 5)
 ORDER BY id DESC LIMIT 300) e LEFT JOIN b_users ON user_id = actor_id"""
SQL["audit_text"] = """
SELECT id, action, coalesce(name, 'System') AS actor_name FROM b_audit LEFT JOIN b_users ON user_id = actor_id
WHERE contains(lower(concat_ws(' ', action, coalesce(name, 'System'), segment)), 'purchase customer#00000001')"""
SQL["cases_in_range"] = f"""
SELECT status, count(*) AS cases FROM b_cases WHERE created_on >= {AS_OF} - 90 GROUP BY 1"""
STEPS["q_people"] = (("b_printed",), """
SELECT case_id, arg_min(full_name, (doc_ord, document_id)) AS person FROM b_printed GROUP BY 1""")
SQL["case_people"] = "SELECT * FROM q_people"
SQL["history_listing"] = """
SELECT case_id, person, overall_risk, recommendation FROM b_cases LEFT JOIN q_people USING (case_id)
WHERE recommendation = 'manual_review_required' AND (contains(lower(title), 'red') OR
  contains(lower(recommendation), 'red') OR contains(lower(coalesce(person, '')), 'red') OR '#' || case_id = 'red')
ORDER BY coalesce(overall_risk, -1) DESC, case_id DESC LIMIT 500"""
SQL["history_by_number"] = """
SELECT case_id, person FROM b_cases LEFT JOIN q_people USING (case_id)
WHERE contains(lower(title), '#77') OR contains(lower(coalesce(recommendation, '')), '#77') OR
  contains(lower(coalesce(person, '')), '#77') OR '#' || case_id = '#77'"""
BUCKET = """CASE WHEN recommendation IS NULL OR overall_risk IS NULL THEN 'pending'
 WHEN recommendation = 'verification_passed' THEN 'valid' WHEN overall_risk >= 60 THEN 'high_risk'
 ELSE 'under_review' END"""
SQL["recent_screenings"] = f"""
SELECT case_id, reference, document_type, person, overall_risk, {BUCKET} AS outcome
FROM (SELECT * FROM b_cases ORDER BY case_id DESC LIMIT 8) c LEFT JOIN q_people USING (case_id)
LEFT JOIN (SELECT case_id, arg_min(document_type, (doc_ord, document_id)) AS document_type FROM b_docs GROUP BY 1) d
     USING (case_id)"""
SQL["display_labels"] = """
SELECT document_type, count(*) AS documents,
  CASE document_type WHEN 'passport' THEN 'Passport' WHEN 'national_id' THEN 'National ID' WHEN 'pan' THEN 'PAN Card'
   WHEN 'driving_licence' THEN 'Driving Licence' WHEN 'voter_id' THEN 'Voter ID (EPIC)' ELSE 'Address Proof' END AS label,
  CASE document_type WHEN 'passport' THEN 'Passport' WHEN 'national_id' THEN 'National Id' WHEN 'pan' THEN 'Tax card'
   WHEN 'driving_licence' THEN 'Driving Licence' WHEN 'voter_id' THEN 'Voter Id' ELSE 'Address Proof' END AS short_label
FROM b_docs GROUP BY 1"""
SQL["case_card"] = """
SELECT c.case_id, reference, status, coalesce(n, 0) AS document_count, coalesce(n, 0) AS version_count,
       newest AS newest_filename, status = 'archived' AS read_only
FROM b_cases c LEFT JOIN (SELECT case_id, count(*) AS n, arg_max(file_name, (issue_d, document_id)) AS newest
                          FROM b_docs GROUP BY 1) d USING (case_id)"""
SQL["latest_versions"] = """
SELECT document_id, max(version_id) AS version_id, arg_max(filename, version_id) AS filename,
       arg_max(sha256, version_id) AS sha256 FROM b_versions GROUP BY 1"""
SQL["version_history"] = """
SELECT document_id, version_id, CAST(p AS INT) AS position FROM (
 SELECT document_id, version_id, row_number() OVER (PARTITION BY document_id ORDER BY version_id DESC) AS p
 FROM b_versions) t"""
SQL["joined_notes"] = """
SELECT conv_id, 0 AS part_no, string_agg(text, '; ' ORDER BY turn) AS text FROM conversations GROUP BY 1"""
SQL["case_detail"] = """
SELECT c.case_id, reference, coalesce(documents, 0) AS documents, newest, coalesce(members, 0) AS members,
       coalesce(editors, 0) AS editors, coalesce(pending, 0) AS pending
FROM b_cases c
LEFT JOIN (SELECT case_id, count(*) AS documents, CAST(max(issue_d) AS VARCHAR) AS newest FROM b_docs GROUP BY 1) d
     USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS members, count(*) FILTER (access = 'editor') AS editors FROM b_members
           GROUP BY 1) m USING (case_id)
LEFT JOIN (SELECT case_id, count(*) FILTER (status = 'pending') AS pending FROM b_reviews GROUP BY 1) r
     USING (case_id)"""

# ---- analytics ---------------------------------------------------------------------------------------
STEPS["q_grants"] = (("b_users", "b_cases", "b_members"), GRANTS)
STEPS["q_case_sums"] = (("b_cases", "b_docs"), """
SELECT case_id, CAST(status IN ('active', 'under_review') AS BIGINT) AS open, coalesce(n, 0) AS n_docs,
       CAST(legal_hold AS BIGINT) AS hold
FROM b_cases LEFT JOIN (SELECT case_id, count(*) AS n FROM b_docs GROUP BY 1) d USING (case_id)""")
SQL["workspace_summary"] = """
SELECT s.*, coalesce(p.n, 0) AS pending_reviews FROM (
 SELECT user_id, count(*) AS total_cases, CAST(sum(open) AS BIGINT) AS active_cases,
        CAST(sum(n_docs) AS BIGINT) AS documents, CAST(sum(hold) AS BIGINT) AS legal_holds
 FROM q_grants JOIN q_case_sums USING (case_id) WHERE scope = 'case' GROUP BY 1
 UNION ALL SELECT user_id, t.* FROM q_grants, (SELECT count(*), CAST(sum(open) AS BIGINT), CAST(sum(n_docs) AS BIGINT),
        CAST(sum(hold) AS BIGINT) FROM q_case_sums) t WHERE scope = 'all') s
LEFT JOIN (SELECT assigned_to AS user_id, count(*) AS n FROM b_reviews WHERE status = 'pending' GROUP BY 1) p
     USING (user_id)"""
SQL["dashboard_summary"] = f"""
SELECT count(*) AS total_screened, count(*) FILTER (b = 'valid') AS valid, count(*) FILTER (b = 'under_review') AS
       under_review, count(*) FILTER (b = 'high_risk') AS high_risk, round_even(avg(overall_risk), 1) AS
       average_risk_score FROM (SELECT *, {BUCKET} AS b FROM b_cases) t"""
STEPS["q_latency"] = (("b_stages",), """
SELECT stage_key, CAST(floor(avg(duration_ms)) AS BIGINT) AS avg_duration_ms, min(duration_ms) AS min_duration_ms,
       max(duration_ms) AS max_duration_ms, upper(stage_key[1]) || stage_key[2:] AS stage_label
FROM b_stages WHERE duration_ms > 0 GROUP BY stage_key""")
SQL["stage_latency"] = "SELECT * FROM q_latency"
STEPS["q_kpis"] = (("b_cases", "b_docs", "q_latency", "q_face_rows"), """
SELECT *, round_even(valid_count / total_cases * 100, 1) AS pass_rate,
       round_even(review_count / total_cases * 100, 1) AS review_rate,
       round_even(high_risk_count / total_cases * 100, 1) AS high_risk_rate,
       (SELECT count(*) FROM b_docs) AS total_documents, (SELECT coalesce(sum(pairs), 0)::BIGINT FROM q_face_rows) AS face_checks,
       (SELECT coalesce(round_even(sum(pairs) FILTER (severity <> 'info') / nullif(sum(pairs), 0) * 100, 1), 0)::DOUBLE FROM q_face_rows)
         AS face_mismatch_rate,
       CAST((SELECT sum(avg_duration_ms) FROM q_latency) AS BIGINT) AS avg_processing_time_ms
FROM (SELECT count(*) AS total_cases, count(*) FILTER (recommendation = 'verification_passed') AS valid_count,
  count(*) FILTER (recommendation IN ('review_recommended', 'unable_to_verify')) AS review_count,
  count(*) FILTER (recommendation = 'manual_review_required' OR overall_risk >= 60) AS high_risk_count,
  round_even(avg(overall_risk), 1) AS average_risk_score FROM b_cases) t""")
SQL["analytics_kpis"] = "SELECT * FROM q_kpis"


def _trend(days: int, slot: str) -> str:
    step = max(1, days // 14)
    return f"""
SELECT CAST(s.slot AS VARCHAR) AS slot, coalesce(valid, 0) AS valid, coalesce(under_review, 0) AS under_review,
       coalesce(high_risk, 0) AS high_risk, coalesce(total, 0) AS total
FROM (SELECT CAST(unnest(generate_series({AS_OF} - {days}, {AS_OF} - {days % step}, INTERVAL {step} DAY)) AS DATE) AS slot) s
LEFT JOIN (SELECT {AS_OF} - CAST(CASE WHEN age >= {days % step} AND age <= {days} AND ({days} - age) % {step} = 0 THEN age
                  ELSE {slot} END AS INT) AS slot,
       count(*) FILTER (k = 'valid') AS valid, count(*) FILTER (k = 'under_review') AS under_review,
       count(*) FILTER (k = 'high_risk') AS high_risk, count(*) AS total
  FROM (SELECT {AS_OF} - created_on AS age, CASE WHEN recommendation = 'verification_passed' THEN 'valid'
               WHEN recommendation = 'manual_review_required' OR coalesce(overall_risk, 0) >= 60 THEN 'high_risk'
               ELSE 'under_review' END AS k FROM b_cases WHERE created_on >= {AS_OF} - {days}) t GROUP BY 1) c
USING (slot)"""


SQL["volume_trend"] = _trend(90, "0")
SQL["volume_trend_floor"] = _trend(
    30, "greatest(0, least(30, 30 - floor((30 - age) / 2) * 2))")
SQL["risk_distribution"] = """
SELECT ord, tier, range_label, coalesce(n, 0) AS count,
       round_even(coalesce(n, 0) / greatest(1, (SELECT count(*) FROM b_cases)) * 100, 1) AS percentage
FROM (VALUES (0, 'Low Risk', '0 – 20'), (1, 'Moderate', '21 – 49'), (2, 'Elevated', '50 – 74'),
             (3, 'Critical', '75 – 100')) d(ord, tier, range_label)
LEFT JOIN (SELECT CASE WHEN coalesce(overall_risk, 10) <= 20 THEN 0 WHEN coalesce(overall_risk, 10) <= 49 THEN 1
                  WHEN overall_risk <= 74 THEN 2 ELSE 3 END AS ord, count(*) AS n FROM b_cases GROUP BY 1) c USING (ord)"""
STEPS["q_ranking"] = (("q_all_findings",), f"""
SELECT field_name, coalesce(n, 0) AS count, coalesce(info, 0) AS info, coalesce(low, 0) AS low,
       coalesce(medium, 0) AS medium, coalesce(high, 0) AS high,
       round_even(coalesce(n, 0) / greatest(1, (SELECT sum(pairs) FROM q_all_findings)) * 100, 1) AS percentage,
       {label('field_name', {'date_of_birth': 'Date of Birth (DOB)', 'full_name': 'Full Legal Name',
                             'facial_photo': 'Facial Biometrics', 'document_number': 'Document / ID Number',
                             'address': 'Residential Address', 'gender': 'Gender / Sex', 'nationality': 'Nationality',
                             'expiry_date': 'Expiration Date', 'issue_date': 'Issue Date'},
              "field_name[1] || lower(field_name[2:])")} AS label
FROM (SELECT unnest(['date_of_birth', 'full_name', 'facial_photo', 'document_number', 'address', 'gender',
                     'nationality']) AS field_name) d
FULL JOIN (SELECT field_name, sum(pairs)::BIGINT AS n, (sum(pairs) FILTER (severity = 'info'))::BIGINT AS info,
   (sum(pairs) FILTER (severity = 'low'))::BIGINT AS low, (sum(pairs) FILTER (severity = 'medium'))::BIGINT AS medium,
   (sum(pairs) FILTER (severity = 'high'))::BIGINT AS high FROM q_all_findings GROUP BY 1) f USING (field_name)""")
SQL["discrepancy_ranking"] = "SELECT * FROM q_ranking"
SQL["document_type_mix"] = f"""
SELECT document_type, {label('document_type', {'passport': 'Passport (ICAO TD3)', 'national_id':
       'National Identity Card', 'pan': 'PAN Card (Income Tax)', 'driving_licence': 'Driving Licence',
       'address_proof': 'Utility / Address Proof'})} AS label, count(*) AS count,
       round_even(count(*) / (SELECT count(*) FROM b_docs) * 100, 1) AS percentage,
       round_even(count(*) FILTER (status = 'valid') / count(*) * 100, 1) AS pass_rate,
       round_even(avg(confidence), 2) AS avg_confidence
FROM q_status JOIN (SELECT document_id, confidence FROM b_docs) d USING (document_id)
WHERE document_type <> 'voter_id' GROUP BY 1"""
def _csv(*values: str) -> str:
    return " || ',' || ".join(f"""'"' || replace(coalesce({v}, ''), '"', '""') || '"'""" for v in values)


SQL["analytics_export"] = f"""
SELECT 'kpis' AS section, FALSE AS is_row, '"METRIC","VALUE"' AS line
UNION ALL SELECT 'trend', FALSE, '"DATE","VALID","UNDER_REVIEW","HIGH_RISK","TOTAL_SCREENED"'
UNION ALL SELECT 'ranking', FALSE, '"DISCREPANCY FIELD","OCCURRENCE COUNT","PERCENTAGE OF TOTAL CONFLICTS"'
UNION ALL SELECT 'types', FALSE, '"DOCUMENT TYPE","COUNT","SHARE (%)","PASS RATE (%)","OCR CONFIDENCE"'
UNION ALL SELECT 'kpis', TRUE, {_csv("m", "v")} FROM (SELECT unnest([
  {{'m': 'Total Cases Screened', 'v': total_cases::VARCHAR}}, {{'m': 'Verification Passed', 'v': valid_count::VARCHAR}},
  {{'m': 'Under Review', 'v': review_count::VARCHAR}}, {{'m': 'High Risk / Fraud Detected', 'v': high_risk_count::VARCHAR}},
  {{'m': 'Pass Rate (%)', 'v': pass_rate::DOUBLE::VARCHAR || '%'}},
  {{'m': 'Average Risk Index (0-100)', 'v': average_risk_score::DOUBLE::VARCHAR}},
  {{'m': 'Average Processing Duration', 'v': avg_processing_time_ms::VARCHAR || ' ms'}},
  {{'m': 'Total Documents Inspected', 'v': total_documents::VARCHAR}},
  {{'m': 'Facial Biometric Checks', 'v': face_checks::VARCHAR}}], recursive := true) FROM q_kpis) t
UNION ALL SELECT 'trend', TRUE, {_csv("slot", "valid::VARCHAR", "under_review::VARCHAR", "high_risk::VARCHAR", "total::VARCHAR")}
FROM ({SQL["volume_trend"]}) t
UNION ALL SELECT 'ranking', TRUE, {_csv("label", "count::VARCHAR", "percentage::DOUBLE::VARCHAR || '%'")} FROM q_ranking
UNION ALL SELECT 'types', TRUE, {_csv("label", "count::VARCHAR", "percentage::DOUBLE::VARCHAR || '%'", "pass_rate::DOUBLE::VARCHAR || '%'",
                                      "format('{:.2f}', avg_confidence::DOUBLE)")} FROM ({SQL["document_type_mix"]}) t"""
STEPS["q_signal_hits"] = (("b_forensics", "q_validations", "q_face_rows"), """
SELECT case_id, 1 AS w, CASE finding_type WHEN 'copy_move_anomaly' THEN 'copy_move_cloning' ELSE finding_type END AS k, score
FROM b_forensics WHERE finding_type <> 'metadata_tamper_indicator'
UNION ALL SELECT case_id, 1, 'qr_barcode_conflict', NULL FROM q_validations
WHERE status = 'fail' AND check_type LIKE 'QR payload%'
UNION ALL SELECT case_id, pairs, 'facial_photo_mismatch', NULL FROM q_face_rows WHERE severity <> 'info'
UNION ALL SELECT case_id, 1, 'mrz_checksum_error', NULL FROM q_validations WHERE status = 'fail' AND check_type = 'MRZ checksum'""")
SQL["signal_rates"] = """
SELECT k AS signal_key, label, category, coalesce(n, 0) AS detected_count, coalesce(c, 0) AS cases,
       round_even(coalesce(c, 0) / (SELECT count(*) FROM b_cases) * 100, 1) AS rate_percent, s AS avg_score
FROM (VALUES ('copy_move_cloning', 'Copy-Move / Stamp Cloning', 'tampering'),
 ('ela_compression_anomaly', 'Error Level Analysis (ELA)', 'tampering'),
 ('facial_photo_mismatch', 'Facial Biometric Discrepancy', 'biometric'),
 ('qr_barcode_conflict', 'QR Payload Discrepancy', 'validation'),
 ('mrz_checksum_error', 'MRZ Check Digit Inconsistency', 'security_feature'),
 ('noise_gradient_anomaly', 'Noise Residual & Font Splicing', 'tampering')) d(k, label, category)
LEFT JOIN (SELECT k, sum(w)::BIGINT AS n, count(DISTINCT case_id) AS c, round_even(avg(score), 2) AS s FROM q_signal_hits
           GROUP BY 1) h USING (k)"""
SQL["stage_rollup"] = """
SELECT case_id, count(*) FILTER (e = 'done') AS done, count(*) FILTER (e = 'warning') AS warning,
  count(*) FILTER (e = 'unavailable') AS unavailable, count(*) FILTER (e = 'error') AS error,
  CASE WHEN count(*) FILTER (e = 'error') > 0 THEN 'failed' ELSE 'completed' END AS status
FROM (SELECT case_id, CASE WHEN stage_key IN ('click', 'view') AND order_index > dead THEN 'unavailable' ELSE o END AS e
 FROM (SELECT *, min(order_index) FILTER (o = 'unavailable') OVER (PARTITION BY case_id) AS dead FROM (
  SELECT *, CASE WHEN stage_key = 'error' AND duration_ms > 2500 THEN 'error' WHEN stage_key = 'purchase' AND
    duration_ms > 1800 THEN 'unavailable' WHEN duration_ms > 1500 THEN 'warning' ELSE 'done' END AS o FROM b_stages) a) b) c
GROUP BY 1"""
SQL["insights"] = """
SELECT CASE WHEN pass_rate >= 80 THEN 'quality_high' ELSE 'review_alert' END AS id,
       CASE WHEN pass_rate >= 80 THEN 'quality' ELSE 'risk_alert' END AS type,
       CASE WHEN pass_rate >= 80 THEN pass_rate || '% Pass Rate' ELSE high_risk_count || ' High-Risk Cases' END AS metric,
       CASE WHEN pass_rate >= 80 THEN 'info' ELSE 'high' END AS importance FROM q_kpis
UNION ALL SELECT 'top_mismatch', 'trend', label || ': ' || count || ' occurrences', 'medium'
FROM (SELECT * FROM q_ranking ORDER BY count DESC, field_name LIMIT 1) r
UNION ALL SELECT 'biometric_integrity', CASE WHEN rate > 5 THEN 'risk_alert' ELSE 'quality' END, rate || '% mismatch rate',
  CASE WHEN rate > 5 THEN 'high' ELSE 'info' END
FROM (SELECT round_even(count(DISTINCT case_id) / (SELECT count(*) FROM b_cases) * 100, 1) AS rate FROM q_face_rows
  WHERE severity <> 'info') r WHERE rate > 0
UNION ALL SELECT 'latency_perf', 'performance', round_even(avg_processing_time_ms / 1000, 2) || 's / case', 'info'
FROM q_kpis"""
SQL["case_numbers"] = """
SELECT case_id, (SELECT max(case_id) + 2000 FROM b_cases WHERE created_on < DATE '1998-01-01') +
       row_number() OVER (ORDER BY created_on, case_id) AS case_number
FROM b_cases WHERE created_on >= DATE '1998-01-01'"""

# ---- text, search --------------------------------------------------------------------------------------
SQL["normalised_fields"] = f"""
SELECT document_id, field_name, CASE WHEN field_name = 'full_name' THEN upper(value)
  WHEN field_name IN ('date_of_birth', 'issue_date', 'expiry_date') THEN CAST({PARSED.format('value')} AS VARCHAR)
  WHEN field_name = 'gender' THEN upper(value[1]) WHEN field_name = 'address'
  THEN trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))
  ELSE upper(trim(value)) END AS normalized_value FROM b_fields"""
SQL["folded_text"] = r"""
SELECT conv_id, turn, upper(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'),
       '\s+', ' ', 'g'))) AS folded FROM conversations"""
STEPS["q_words"] = (("b_versions",), """
SELECT DISTINCT version_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,40}')) AS word FROM b_versions""")
SQL["search_index"] = f"SELECT version_id, {hmac(chr(39) + 'search:' + chr(39) + ' || word')} AS token_hash FROM q_words"
SQL["evidence_search"] = """
SELECT query_id, version_id FROM (
 SELECT query_id, version_id, count(*) AS m FROM (
   SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,40}')) AS word
   FROM benchmark) q JOIN q_words USING (word) GROUP BY 1, 2) h
JOIN (SELECT item_id AS query_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,40}'))) AS n
      FROM benchmark) b USING (query_id) WHERE m = n"""
SQL["document_search"] = """
SELECT document_id, created_on FROM (
 SELECT document_id, max(version_id) AS created_on, min(source) AS title, min(lang) AS kind FROM b_versions GROUP BY 1) d
WHERE kind = 'en' AND (title ILIKE '%the with%' OR document_id IN (
  SELECT document_id FROM b_versions WHERE filename ILIKE '%the with%' OR version_id IN (
    SELECT version_id FROM q_words WHERE word IN ('the', 'with') GROUP BY 1 HAVING count(*) = 2)))
ORDER BY created_on DESC, document_id DESC LIMIT 100"""

# ---- consistency and fusion -----------------------------------------------------------------------------
SQL["name_agreement"] = f"""
SELECT case_id, document_id, full_name AS value, first_value,
       {name_agree(NAME_TOKENS.format('first_value'), NAME_TOKENS.format('full_name'))} AS agrees
FROM b_printed JOIN (SELECT case_id, arg_min(full_name, (doc_ord, document_id)) AS first_value FROM b_printed GROUP BY 1)
     f USING (case_id)"""
SQL["address_agreement"] = f"""
SELECT case_id, document_id, {address_agree(ADDRESS_TOKENS.format('first_value'), ADDRESS_TOKENS.format('address'))}
       AS agrees
FROM b_printed JOIN (SELECT case_id, arg_min(address, (doc_ord, document_id)) AS first_value FROM b_printed GROUP BY 1)
     f USING (case_id)"""
SQL["consistency_findings"] = "SELECT * FROM q_findings"
STEPS["q_forms"] = (("b_fields",), f"""
SELECT case_id, field_name, doc_ord, document_id, file_name,
       CASE WHEN field_name IN ('document_number', 'issue_date', 'expiry_date') THEN document_type ELSE '' END AS type_key,
       CASE WHEN field_name = 'full_name' THEN array_to_string({NAME_TOKENS.format('value')}, ' ')
            WHEN field_name = 'address' THEN array_to_string({ADDRESS_TOKENS.format('value')}, ' ')
            WHEN field_name IN ('date_of_birth', 'issue_date', 'expiry_date') THEN CAST({PARSED.format('value')} AS VARCHAR)
            ELSE upper(trim(value)) END AS form
FROM b_fields""")
SQL["conflict_parts"] = """
SELECT case_id, field_name, type_key, lead.d AS cluster_document, 0::INT AS part_no,
       string_agg(file_name, ', ' ORDER BY doc_ord, document_id, file_name) || ' → ' || lead.v AS part
FROM q_forms JOIN q_vclusters USING (case_id, field_name, type_key, form)
WHERE (case_id, field_name, type_key) IN (SELECT (case_id, field_name, type_key) FROM q_findings WHERE severity <> 'info')
GROUP BY case_id, field_name, type_key, lead"""
SQL["field_names"] = "SELECT field_name, count(DISTINCT case_id) AS cases FROM b_fields GROUP BY 1"
STEPS["q_support"] = (("q_values",), f"""
SELECT v.case_id, v.field_name, v.type_key, v.form, any_value(v.toks) AS toks, any_value(v.n) AS n,
       any_value(v.pos) AS pos, sum(CASE WHEN CASE WHEN v.field_name IN ('full_name', 'address')
       THEN {agree('v.field_name', 'w.toks', 'v.toks')} ELSE v.form = w.form END THEN w.n ELSE 0 END) AS agreeing
FROM q_values v JOIN q_values w USING (case_id, field_name, type_key) GROUP BY 1, 2, 3, 4""")
STEPS["q_reference"] = (("q_support",), """
SELECT case_id, field_name, any_value(total) AS n_values, max(tt) AS n_same_type,
       arg_min({'f': form, 't': type_key, 'k': toks, 'v': pos.v}, (-(agreeing + total - tt), pos)) AS ref
FROM (SELECT *, sum(n) OVER (PARTITION BY case_id, field_name) AS total,
             sum(n) OVER (PARTITION BY case_id, field_name, type_key) AS tt FROM q_support) s GROUP BY 1, 2""")
SQL["comparison_table"] = f"""
SELECT case_id, field_name, {_LABEL} AS label, trim(ref.v) AS reference_value, CAST(n_values AS BIGINT) AS n_values,
       CAST(bad AS BIGINT) AS n_disagree, CAST(comparable AS BIGINT) AS comparable,
       CASE WHEN mismatch THEN 'mismatch' WHEN comparable >= 2 THEN 'consistent' ELSE 'single_source' END AS status,
       CASE WHEN mismatch THEN CASE WHEN severity = 'info' THEN 'medium' ELSE severity END END AS severity,
       CASE WHEN mismatch THEN explanation WHEN comparable >= 2 THEN {_LABEL} || ' is consistent across all ' ||
            comparable || ' comparable documents.' END AS explanation
FROM (SELECT *, bad > 0 AND severity IS NOT NULL AND comparable >= 2 AS mismatch FROM (
 SELECT r.*, CASE WHEN r.field_name IN ('document_number', 'issue_date', 'expiry_date') THEN n_same_type ELSE n_values END
        AS comparable, bad, severity, explanation
 FROM q_reference r
 JOIN (SELECT s.case_id, s.field_name, sum(CASE WHEN s.type_key <> r.ref.t THEN 0 WHEN
         CASE WHEN s.field_name IN ('full_name', 'address') THEN {agree('s.field_name', 's.toks', 'r.ref.k')}
              ELSE s.form = r.ref.f END THEN 0 ELSE n END) AS bad
       FROM q_support s JOIN q_reference r USING (case_id, field_name) GROUP BY 1, 2) b USING (case_id, field_name)
 LEFT JOIN (SELECT case_id, field_name, arg_max(severity, type_key) AS severity,
                   arg_max(explanation, type_key) AS explanation FROM q_findings GROUP BY 1, 2) f
      USING (case_id, field_name)) t) u"""
_FORM = (f"CASE WHEN field_name = 'full_name' THEN array_to_string({NAME_TOKENS.format('value')}, ' ') "
         f"WHEN field_name = 'address' THEN array_to_string({ADDRESS_TOKENS.format('value')}, ' ') "
         f"WHEN field_name = 'date_of_birth' THEN CAST({PARSED.format('value')} AS VARCHAR) ELSE upper(trim(value)) END")
_TOKS = (f"CASE WHEN field_name = 'full_name' THEN {NAME_TOKENS.format('value')} "
         f"WHEN field_name = 'address' THEN {ADDRESS_TOKENS.format('value')} END")
STEPS["q_printed_text"] = (("b_fields",), """
SELECT case_id, field_name, arg_min(value, (doc_ord, document_id)) AS ocr_value,
       round_even(avg(confidence), 1) AS ocr_confidence, count(*) AS n_documents
FROM b_fields WHERE field_name IN ('full_name', 'date_of_birth', 'document_number', 'address', 'gender') GROUP BY 1, 2""")
STEPS["q_sources"] = (("b_fields", "q_printed_text", "q_qr", "q_mrz"), f"""
SELECT case_id, field_name, form, any_value(toks) AS toks, sum(w) AS n, min(pos) AS pos FROM (
 SELECT *, {_FORM} AS form, {_TOKS} AS toks FROM (
  SELECT case_id, field_name, value, 1 AS w,
         {{'r': 3, 'o': doc_ord, 'd': document_id, 's': file_name || ' (' || document_type || ')', 'v': value}} AS pos
  FROM b_fields WHERE field_name IN ('full_name', 'date_of_birth', 'document_number', 'address', 'gender')
  UNION ALL SELECT case_id, field_name, ocr_value, CASE WHEN n_documents > 1 THEN 1 ELSE 0 END,
         {{'r': 0, 'o': 0, 'd': '', 's': 'Printed OCR', 'v': ocr_value}} FROM q_printed_text
  UNION ALL SELECT case_id, field_name, v, 1, {{'r': 1, 'o': 0, 'd': '', 's': 'Digital QR', 'v': v}} FROM (
   SELECT case_id, CASE check_type WHEN 'QR payload vs document number' THEN 'document_number'
          WHEN 'QR payload vs name' THEN 'full_name' ELSE 'date_of_birth' END AS field_name,
          arg_min(coded, (doc_ord, document_id)) AS v FROM q_qr GROUP BY 1, 2) q
  UNION ALL SELECT case_id, field_name, v, 1, {{'r': 2, 'o': 0, 'd': '', 's': 'Passport MRZ', 'v': v}} FROM (
   SELECT case_id, CASE check_type WHEN 'MRZ vs printed document number' THEN 'document_number'
          WHEN 'MRZ vs printed name' THEN 'full_name' ELSE 'date_of_birth' END AS field_name,
          arg_min(coded, (doc_ord, document_id)) AS v FROM q_mrz WHERE coded IS NOT NULL GROUP BY 1, 2) z) s) t
GROUP BY 1, 2, 3""")
STEPS.update(leaders("q_sources", "q_s", "case_id, field_name"))
STEPS["q_fusion"] = (("q_sclusters", "q_printed_text"), f"""
SELECT case_id, field_name, {_LABEL} AS label, ocr_value, ocr_confidence, consensus_value,
       n_sources, n_clusters, agreement_status, CASE agreement_status
  WHEN 'single_source' THEN 'Single source available for verification.'
  WHEN 'unanimous' THEN 'All ' || n_sources || ' sources agree unanimously (' || consensus_value || ').'
  WHEN 'majority_conflict' THEN top || ' sources agree (''' || consensus_value || '''), 1 differs (' || outlier.s ||
       ': ''' || outlier.v || '''). Potential tampering in ' || outlier.s || '.'
  ELSE 'Multiple conflicting sources: ' || n_clusters || ' values from ' || n_sources || ' sources.' END ||
  CASE WHEN weak THEN ' (Caution: Low OCR confidence detected).' ELSE '' END AS conflict_summary,
  CASE WHEN weak THEN 'high' WHEN agreement_status = 'majority_conflict' THEN 'elevated'
       WHEN agreement_status = 'mismatch' THEN 'high' ELSE 'normal' END AS caution_level
FROM (SELECT *, ocr_confidence < 70 AND agreement_status <> 'unanimous' AS weak FROM (
 SELECT *, CASE WHEN n_sources <= 1 THEN 'single_source' WHEN n_clusters = 1 THEN 'unanimous'
   WHEN top >= 2 AND n_clusters = 2 AND n_sources - top = 1 THEN 'majority_conflict' ELSE 'mismatch' END
   AS agreement_status FROM (
  SELECT case_id, field_name, CAST(sum(size) AS BIGINT) AS n_sources, count(*) AS n_clusters,
         CAST(arg_min(size, (-size, lead)) AS BIGINT) AS top, arg_min(lead, (-size, lead)).v AS consensus_value,
         arg_max(lead, (-size, lead)) AS outlier
  FROM (SELECT case_id, field_name, lead_form, min(lead) AS lead, sum(n) AS size FROM q_sclusters GROUP BY 1, 2, 3) a
  GROUP BY 1, 2) b LEFT JOIN q_printed_text USING (case_id, field_name)) c) d""")
SQL["fusion_matrix"] = "SELECT * FROM q_fusion"
SQL["evidence_nodes"] = """
SELECT case_id, 'person-root' AS node_id, 'person' AS node_type, consensus_value AS label,
       CASE WHEN coalesce(overall_risk, 0) >= 60 THEN 'mismatch' WHEN coalesce(overall_risk, 0) >= 30 THEN 'warning'
            ELSE 'verified' END AS status, CAST(100 - coalesce(overall_risk, 0) AS DOUBLE) AS confidence
FROM b_cases JOIN q_fusion USING (case_id) WHERE field_name = 'full_name'
UNION ALL SELECT case_id, 'doc-' || document_id, 'document', CASE document_type WHEN 'passport' THEN 'Passport'
  WHEN 'national_id' THEN 'National Id' WHEN 'pan' THEN 'Pan' WHEN 'driving_licence' THEN 'Driving Licence'
  WHEN 'voter_id' THEN 'Voter Id' ELSE 'Address Proof' END,
  CASE WHEN doc_ord = 7 THEN 'warning' ELSE 'verified' END, round_even(confidence / 100 * 100, 0) FROM b_docs
UNION ALL SELECT case_id, 'field-' || field_name, 'field', label || ': ' || consensus_value,
  CASE agreement_status WHEN 'unanimous' THEN 'verified' WHEN 'majority_conflict' THEN 'mismatch' ELSE 'warning' END,
  ocr_confidence FROM q_fusion"""
SQL["evidence_edges"] = f"""
SELECT case_id, 'person-root' AS source, 'doc-' || document_id AS target, 'submitted' AS label, 'neutral' AS status
FROM b_docs
UNION ALL SELECT case_id, 'doc-' || document_id, 'field-' || field_name, value, CASE WHEN CASE
  WHEN field_name = 'full_name' THEN {name_agree(NAME_TOKENS.format('value'), NAME_TOKENS.format('consensus_value'))}
  WHEN field_name = 'address' THEN {address_agree(ADDRESS_TOKENS.format('value'), ADDRESS_TOKENS.format('consensus_value'))}
  WHEN field_name = 'date_of_birth' THEN {PARSED.format('value')} = {PARSED.format('consensus_value')}
  ELSE upper(trim(value)) = upper(trim(consensus_value)) END THEN 'agree' ELSE 'conflict' END
FROM b_fields JOIN q_fusion USING (case_id, field_name)"""

# ---- checks of documents -----------------------------------------------------------------------------------
SQL["validation_checks"] = "SELECT * FROM q_checks"
SQL["missing_fields"] = """
SELECT case_id, document_id, document_type, 'nationality' AS field_name FROM b_printed
WHERE document_type = 'passport' AND nationality IS NULL"""
SQL["document_status"] = "SELECT * FROM q_status"
SQL["extraction_completeness"] = """
SELECT case_id, count(DISTINCT document_id) AS n_documents, count(*) AS n_fields, true AS any_fields
FROM b_fields GROUP BY 1"""
SQL["text_status"] = """
SELECT doc_id AS document_id, passed, failed, warned, CASE WHEN lang = 'de' AND passed = 0 THEN 'unable_to_verify'
  WHEN failed + warned > 0 THEN 'review_required' ELSE 'valid' END AS status
FROM (SELECT doc_id, lang, CAST(coalesce(quality = 1, false) AS BIGINT) AS passed,
             CAST(coalesce(quality = 0, false) AS BIGINT) AS failed, CAST(coalesce(toxic = 1, false) AS BIGINT) AS warned
      FROM documents LEFT JOIN labels USING (doc_id)) t"""
SQL["rule_age"] = "SELECT * FROM q_rule_age"
SQL["rule_dates"] = "SELECT * FROM q_rule_dates"
SQL["date_issues"] = "SELECT document_id, issue_no, issue FROM q_date_issues"
SQL["rule_pan"] = "SELECT * FROM q_rule_pan"


def digit(text: str) -> str:
    return (f"CAST(list_sum(list_transform(string_split({text}, ''), lambda ch, i: greatest(instr("
            f"'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ch) - 1, 0) * ([7, 3, 5])[((i - 1) % 3 + 1)::INT])) % 10 AS VARCHAR)")


SQL["mrz_check_digits"] = f"""
SELECT document_id, {digit("rpad(upper(document_number), 9, '<')")} AS number_digit,
       {digit("strftime(dob_d, '%y%m%d')")} AS dob_digit FROM b_printed"""
SQL["mrz_parse"] = """
SELECT document_id, CASE WHEN l_tax < 0.02 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score, 'P' AS doc_code,
       'IND' AS issuing_state, upper(split_part(p_name, ' ', 2)) AS surname, upper(split_part(p_name, ' ', 1)) AS
       given_names, document_number, 'IND' AS nationality, CAST(dob_d AS VARCHAR) AS dob, gender[1] AS sex,
       CAST(expiry_d AS VARCHAR) AS expiry, CAST(l_suppkey AS VARCHAR) AS personal_number,
       l_tax >= 0.02 AS document_number_ok, true AS date_of_birth_ok, true AS expiry_date_ok, true AS personal_number_ok,
       true AS composite_ok FROM b_printed WHERE document_type = 'passport'"""
SQL["mrz_compare"] = "SELECT document_id, check_type, status, message FROM q_mrz"
SQL["qr_compare"] = "SELECT document_id, check_type, status, message FROM q_qr"
SQL["extract_fields"] = """
SELECT document_id, field_name, normalized_value, CASE WHEN field_name = 'nationality' THEN 95.0::DOUBLE
       ELSE round_even(confidence, 1) END AS confidence
FROM (SELECT document_id, confidence,
  unnest(['full_name', 'date_of_birth', 'gender', 'document_number', 'issue_date', 'expiry_date', 'nationality'])
    AS field_name,
  unnest([upper(full_name), CAST(dob_d AS VARCHAR), gender[1], document_number, CAST(issue_d AS VARCHAR),
          CAST(expiry_d AS VARCHAR), CASE WHEN document_type = 'passport' THEN 'IND' END]) AS normalized_value
  FROM b_printed) t WHERE normalized_value IS NOT NULL"""
SQL["mean_confidence"] = "SELECT document_id, round_even(confidence, 1) AS mean_confidence FROM b_docs"


def _score(template: dict, text: str) -> str:
    words = " + ".join(f"CASE WHEN contains(lower({text}), '{w.replace(chr(39), chr(39) * 2)}') THEN {v}::DOUBLE ELSE 0 END"
                       for w, v in template["keywords"].items())
    marks = "".join(f" + CASE WHEN regexp_matches({text}, '(?i){p}') THEN 4.5::DOUBLE ELSE 0 END"
                    for p in template["patterns"])
    most = sum(template["keywords"].values()) + 1.0 + 4.5 * len(template["patterns"])
    return f"({words}{marks}) / {most}::DOUBLE"


def _classified(source: str, uncertain: str) -> str:
    from dossier.policy import TEMPLATES
    scores = ", ".join(f"{{'s': {_score(t, 'text')}, 'o': {-i}, 'k': '{name}'}}"
                       for i, (name, t) in enumerate(TEMPLATES.items()))
    return f"""
SELECT document_id, CASE WHEN b.s >= 0.22 THEN b.k ELSE '{uncertain}' END AS document_type,
       round_even(CASE WHEN b.s >= 0.22 THEN least(b.s, 1.0) ELSE least(b.s, 0.22) END::DOUBLE, 2) AS type_confidence
FROM (SELECT document_id, list_max([{scores}]) AS b FROM ({source}) t) u"""


SQL["classify_text"] = _classified("""
SELECT document_id, concat_ws(' ', upper(replace(document_type, '_', ' ')), CASE document_type
  WHEN 'passport' THEN 'REPUBLIC OF INDIA SURNAME NATIONALITY P<IND TYPE P'
  WHEN 'pan' THEN 'INCOME TAX DEPARTMENT PERMANENT ACCOUNT NUMBER'
  WHEN 'voter_id' THEN 'ELECTION COMMISSION VOTER EPIC NO IDENTITY CARD ELECTOR' END, document_number, full_name) AS text
FROM b_printed""", "other")
SQL["classify_documents"] = _classified("SELECT doc_id AS document_id, text FROM documents", "unknown")

# ---- reuse, features ------------------------------------------------------------------------------------------
SQL["exact_reuse"] = """
SELECT version_id AS document_id, copies - 1 AS hits, CASE WHEN version_id = a THEN z ELSE a END AS other_document_id,
       source = CASE WHEN version_id = a THEN zs ELSE aset END AS same_case
FROM b_versions JOIN (SELECT sha256, count(*) AS copies, min(version_id) AS a, max(version_id) AS z,
  arg_min(source, version_id) AS aset, arg_max(source, version_id) AS zs FROM b_versions GROUP BY 1
  HAVING count(*) > 1) g USING (sha256)"""
SQL["reuse_hits"] = """
SELECT file_hash, document_id, other_document_id, CAST(rank AS INT) AS rank FROM (
 SELECT a.sha256 AS file_hash, a.version_id AS document_id, o.version_id AS other_document_id,
        row_number() OVER (PARTITION BY a.version_id ORDER BY o.version_id) AS rank
 FROM b_versions a JOIN (SELECT sha256, version_id, row_number() OVER (PARTITION BY sha256 ORDER BY version_id) AS r
   FROM b_versions) o ON o.sha256 = a.sha256 AND o.r <= 6 AND o.version_id <> a.version_id) t WHERE rank <= 5"""
SQL["reuse_messages"] = "SELECT document_id, message FROM q_reuse_rows"
SQL["near_reuse"] = """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,40}')) AS word FROM documents),
h AS (SELECT doc_id, ('0x' || sha256(word)[1:8])::BIGINT AS hi, ('0x' || sha256(word)[9:16])::BIGINT AS lo FROM w),
v AS (SELECT doc_id, b, 2 * sum(CASE WHEN b < 32 THEN (lo >> b) & 1 ELSE (hi >> (b - 32)) & 1 END) > count(*) AS one
      FROM h, (SELECT unnest(range(64)) AS b) r GROUP BY 1, 2),
f AS (SELECT doc_id, sum(CASE WHEN one AND b >= 32 THEN 1::BIGINT << (b - 32) ELSE 0 END)::BIGINT AS hi,
             sum(CASE WHEN one AND b < 32 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS lo FROM v GROUP BY 1),
g AS (SELECT CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END AS shi, hi, lo, count(*) AS n,
             min(doc_id) AS doc_id FROM
      (SELECT doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM documents LEFT JOIN f USING (doc_id)) d
      GROUP BY 1, 2, 3)
SELECT a.doc_id AS document_a, b.doc_id AS document_b, a.n AS copies_a, b.n AS copies_b,
       CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INT) AS distance
FROM g a JOIN g b ON (a.shi, a.lo) < (b.shi, b.lo)
WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8"""
SQL["feature_match"] = "SELECT * FROM q_matched"
SQL["face_findings"] = "SELECT * FROM q_face_findings"

# ---- image figures -----------------------------------------------------------------------------------------------
FIGURES = """(SELECT document_id, l_quantity * 4 AS sharpness, l_partkey % 1400 + 300 AS width,
  l_suppkey * 13 % 1300 + 300 AS height, l_discount * 2 AS glare, l_partkey % 256 AS brightness, l_tax * 70 AS moire,
  l_partkey % 90 AS contrast FROM b_docs)"""
SQL["quality_verdict"] = f"""
SELECT document_id, sharpness_status, resolution_status, glare_status, CASE WHEN poor THEN 'fail' WHEN
  sharpness_status <> 'good' OR resolution_status = 'poor' OR glare_status = 'poor' THEN 'warning' ELSE 'pass' END AS
  status, NOT poor AS trust_ocr
FROM (SELECT *, sharpness_status = 'poor' AND (resolution_status = 'poor' OR glare_status = 'poor') AS poor FROM (
 SELECT document_id, CASE WHEN sharpness >= 100 THEN 'good' WHEN sharpness >= 50 THEN 'acceptable' ELSE 'poor' END AS
  sharpness_status, CASE WHEN least(width, height) >= 800 AND width * height >= 600000 THEN 'good' WHEN
  least(width, height) >= 500 THEN 'acceptable' ELSE 'poor' END AS resolution_status, CASE WHEN glare > 0.15::DOUBLE OR
  brightness > 235 THEN 'poor' WHEN glare > 0.08::DOUBLE OR brightness < 40 THEN 'warning' ELSE 'good' END AS glare_status
 FROM {FIGURES} f) g) h"""
SQL["capture_verdict"] = f"""
SELECT document_id, CASE WHEN moire >= 4.6::DOUBLE THEN 'potential_screen_replay' WHEN glare >= 0.08::DOUBLE THEN
  'screen_or_glossy_replay' WHEN sharpness < 25 OR contrast < 20 THEN 'low_quality_capture' ELSE 'genuine_photo' END AS
  capture_status, CASE WHEN moire >= 4.6::DOUBLE THEN 75 WHEN glare >= 0.08::DOUBLE THEN 65 WHEN sharpness < 25 OR
  contrast < 20 THEN 40 ELSE 10 END AS capture_risk FROM {FIGURES} f"""
SQL["document_suspicion"] = """
SELECT case_id, document_id, coalesce(n, 0) AS n_findings, p AS suspicion_percent,
       CASE WHEN p >= 66 THEN 'high' WHEN p >= 33 THEN 'medium' ELSE 'low' END AS suspicion
FROM (SELECT case_id, document_id, n, CAST(coalesce(round_even(s * 100, 0), 0) AS INT) AS p FROM b_docs LEFT JOIN
 (SELECT document_id, count(*) AS n, max(score) AS s FROM b_forensics GROUP BY 1) f USING (document_id)) t"""
SQL["signature_scan"] = """
SELECT page_id AS document_id, array_to_string(list_transform(list_filter(['affinity', 'canva', 'coreldraw', 'gimp',
  'illustrator', 'inkscape', 'meta charset', 'paint.net', 'photoshop', 'picsart', 'pixelmator', 'track('],
  lambda w: contains(lower(html), w)), lambda w: CASE w WHEN 'meta charset' THEN 'Meta Charset'
  ELSE upper(w[1]) || w[2:] END), ', ') AS tools, 'high' AS severity, 0.85::DOUBLE AS score
FROM pages WHERE contains(lower(html), 'meta charset') OR contains(lower(html), 'track(') OR
  regexp_matches(lower(html), 'affinity|canva|coreldraw|gimp|illustrator|inkscape|paint\\.net|photoshop|picsart|pixelmator')"""


def zone(x: str, y: str, kind: str) -> str:
    from dossier.policy import ZONES
    cases = " ".join(
        f"WHEN {kind} = '{name}' AND {x} BETWEEN {x0}::DOUBLE AND {x1}::DOUBLE AND {y} BETWEEN {y0}::DOUBLE AND "
        f"{y1}::DOUBLE THEN '{z}'" for name, boxes in ZONES.items() for z, x0, y0, x1, y1 in boxes)
    return (f"CASE {cases} ELSE CASE WHEN {y} < 0.5 THEN 'upper' ELSE 'lower' END || ' ' || CASE WHEN {x} < 0.33::DOUBLE "
            f"THEN 'left' WHEN {x} < 0.66::DOUBLE THEN 'central' ELSE 'right' END || ' region' END")


SQL["zones"] = f"""
SELECT document_id, {zone('x', 'y', 'document_type')} AS region FROM (
 SELECT document_id, document_type, (l_partkey % 100) / 99.0::DOUBLE AS x, (l_suppkey * 7 % 100) / 99.0::DOUBLE AS y
 FROM b_docs) t"""

# ---- risk, report, notices ----------------------------------------------------------------------------------------
SQL["case_evidence"] = "SELECT * FROM q_evidence"
SQL["risk_ledger"] = "SELECT * FROM q_ledger"
STEPS["q_scores"] = (("q_evidence", "q_ledger"), f"""
SELECT case_id, score, n_factors, {_BAND.format('score')} AS band, CASE WHEN n_fields + n_read = 0 THEN 'unable_to_verify'
  WHEN score <= 29 THEN 'verification_passed' WHEN score <= 59 THEN 'review_recommended' ELSE 'manual_review_required' END
  AS recommendation
FROM (SELECT case_id, n_fields, n_read, CAST(greatest(0, least(100, coalesce(t, 0))) AS BIGINT) AS score,
             coalesce(k, 0) AS n_factors FROM q_evidence LEFT JOIN
  (SELECT case_id, sum(score) AS t, count(*) AS k FROM q_ledger GROUP BY 1) l USING (case_id)) u""")
SQL["risk_score"] = "SELECT * FROM q_scores"
SQL["ledger_positions"] = """
SELECT case_id, factor, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, factor) AS INT) AS position
FROM q_ledger"""
SQL["capped_sums"] = """
SELECT case_id, CAST(sum(CASE severity WHEN 'high' THEN least(n, 1) * 25 WHEN 'medium' THEN least(n, 2) * 12 ELSE n END)
       AS BIGINT) AS total FROM (SELECT case_id, severity, count(*) AS n FROM b_forensics GROUP BY 1, 2) t GROUP BY 1"""
SQL["risk_bands"] = f"""
SELECT CASE WHEN overall_risk IS NOT NULL THEN {_BAND.format('overall_risk')} END AS band, recommendation,
       count(*) AS cases FROM b_cases GROUP BY 1, 2"""
STEPS["q_modules"] = (("b_docs", "q_all_findings", "b_forensics", "q_validations"), """
SELECT d.*, coalesce(fhard, 0) AS fhard, coalesce(fsame, 0) AS fsame, coalesce(hard, 0) AS hard, coalesce(cons, 0) AS cons, coalesce(flagged, 0) AS flagged,
       coalesce(fails, 0) AS fails, coalesce(warns, 0) AS warns, coalesce(reused, 0) AS reused
FROM (SELECT case_id, count(*) AS docs, count(*) FILTER (l_linestatus = 'F') AS readable FROM b_docs GROUP BY 1) d
LEFT JOIN (SELECT case_id, count(*) FILTER (severity IN ('medium', 'high')) AS hard, count(*) FILTER (severity = 'info')
  AS cons, count(*) FILTER (field_name = 'facial_photo' AND severity IN ('medium', 'high')) AS fhard,
  count(*) FILTER (field_name = 'facial_photo' AND severity = 'info') AS fsame
  FROM q_all_findings GROUP BY 1) f USING (case_id)
LEFT JOIN (SELECT case_id, count(DISTINCT document_id) AS flagged FROM b_forensics WHERE severity IN ('medium', 'high')
  GROUP BY 1) x USING (case_id)
LEFT JOIN (SELECT case_id, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warning') AS warns,
  count(*) FILTER (check_type = 'Duplicate / reuse') AS reused FROM q_validations GROUP BY 1) v USING (case_id)""")
SQL["report_modules"] = """
SELECT case_id, 'Consistency check' AS module, CASE WHEN hard > 0 THEN 'mismatch' WHEN cons > 0 THEN 'consistent'
  ELSE 'not_applicable' END AS outcome, CASE WHEN hard > 0 THEN hard || ' conflicting field(s)' ELSE cons ||
  ' shared field(s) consistent' END AS detail FROM q_modules
UNION ALL SELECT case_id, 'Tampering detection', CASE WHEN flagged > 0 THEN 'suspicious' ELSE 'clear' END,
  CASE WHEN flagged > 0 THEN 'Indicators in ' || flagged || ' document(s)' ELSE 'No significant indicators' END FROM q_modules
UNION ALL SELECT case_id, 'Document validation & MRZ', CASE WHEN fails > 0 THEN 'issues' WHEN warns > 0 THEN 'warnings'
  ELSE 'passed' END, fails || ' failed, ' || warns || ' warning check(s)' FROM q_modules
UNION ALL SELECT case_id, 'Reuse / duplicate scan', CASE WHEN reused > 0 THEN 'reuse_detected' ELSE 'clear' END,
  CASE WHEN reused > 0 THEN reused || ' document(s) matched earlier submissions' ELSE 'No earlier matches' END FROM q_modules
UNION ALL SELECT case_id, 'Facial cross-matching', CASE WHEN fhard > 0 THEN 'mismatch' ELSE 'matched' END,
  CASE WHEN fhard > 0 THEN fhard || ' photo mismatch detected across documents' ELSE
  'Consistent facial photos across 0 documents' END FROM q_modules WHERE fhard + fsame > 0
UNION ALL SELECT case_id, 'OCR extraction', CASE WHEN readable = docs THEN 'ok' WHEN readable > 0 THEN 'partial' ELSE
  'unavailable' END, readable || '/' || docs || ' document(s)' FROM q_modules
UNION ALL SELECT case_id, 'Face verification', 'unavailable',
  'Not available in this configuration; other evidence was still evaluated' FROM q_modules"""
SQL["key_findings"] = """
SELECT case_id, 1 AS section, 'error' AS level, explanation AS text FROM q_all_findings WHERE severity IN ('medium', 'high')
UNION ALL SELECT case_id, 2, CASE severity WHEN 'high' THEN 'error' ELSE 'warning' END, CASE severity WHEN 'high' THEN
  'High-suspicion region in the ' ELSE 'Suspicious indicators in the ' END || region || ' (score ' ||
  CAST(floor(score * 100) AS BIGINT) || '/100).' FROM b_forensics WHERE severity IN ('medium', 'high')
UNION ALL SELECT case_id, 3, 'error', message FROM q_validations WHERE status = 'fail'
UNION ALL SELECT case_id, 3, 'warning', message FROM q_validations WHERE status = 'warning' AND check_type IN
  ('Expiration status', 'Duplicate / reuse', 'QR payload vs name')
UNION ALL SELECT DISTINCT case_id, 4, 'success', 'MRZ checksum verification passed.' FROM q_validations
  WHERE check_type = 'MRZ checksum' AND status = 'pass'
UNION ALL SELECT case_id, 5, 'success', explanation FROM q_all_findings WHERE severity = 'info'"""
SQL["report_fields"] = f"""
SELECT document_id, CASE field_name WHEN 'full_name' THEN 0 WHEN 'document_number' THEN 1 WHEN 'date_of_birth' THEN 2
  ELSE 9 END AS field_order, {_LABEL} AS label, value, status AS document_status
FROM b_fields JOIN (SELECT document_id, status FROM q_status) s USING (document_id)"""
STEPS["q_discrepancies"] = (("q_all_findings", "q_validations", "b_forensics", "b_docs"), f"""
SELECT case_id, 1 AS source, field_name, {label('field_name', FIELD_LABELS, "field_name[1] || lower(field_name[2:])")}
  AS label, severity, explanation, CAST(NULL AS VARCHAR) AS document_id FROM q_all_findings
WHERE severity IN ('medium', 'high')
UNION ALL SELECT v.case_id, 2, replace(lower(check_type), ' ', '_'), check_type, 'high', message || ' (' || file_name || ')',
  document_id FROM q_validations v JOIN (SELECT document_id, file_name FROM b_docs) d USING (document_id)
  WHERE status = 'fail'
UNION ALL SELECT case_id, 3, 'forensic_' || region, 'Visual Tampering (' || region || ')', severity,
  'Localized anomaly detected in ' || region || ' (' || file_name || ')', document_id FROM b_forensics
  WHERE severity = 'high'""")
SQL["discrepancy_union"] = "SELECT case_id, source, field_name, label, severity, explanation FROM q_discrepancies"
SQL["outbox"] = """
SELECT case_id, channel, CASE channel WHEN 'email' THEN email ELSE phone END AS recipient, CASE channel WHEN 'email' THEN
  'Your papers in case ' || case_id || ' need another look' END AS subject,
  'Dear ' || coalesce(array_to_string(list_transform(string_split(lower(trim(person)), ' '), lambda w: upper(w[1]) || w[2:]),
   ' '), array_to_string(list_transform(string_split(lower(title), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) ||
  ', something in your case ' || case_id || ' does not fit together yet: ' ||
  CASE WHEN n > 0 THEN labels || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END
       ELSE 'verification findings' END ||
  '. Look at the case online, or ask the person in charge of it which papers to send again.' AS message,
  coalesce(n, 0) AS discrepancies, 'automatic' AS trigger_type
FROM (SELECT c.case_id, title, overall_risk, person, n, labels,
  CASE WHEN c.case_id % 3 <> 0 THEN 'c' || c.case_id || '@example.org' END AS email,
  CASE WHEN c.case_id % 2 = 0 THEN '+91' || c.case_id END AS phone,
  CASE WHEN c.case_id % 2 = 0 THEN 'sms' WHEN c.case_id % 3 <> 0 THEN 'email' END AS channel
 FROM b_cases c LEFT JOIN q_people USING (case_id) LEFT JOIN (
  SELECT case_id, max(n) AS n, string_agg(label, ', ' ORDER BY r) AS labels FROM (
   SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source, coalesce(document_id, ''), field_name, explanation)
      AS r, count(*) OVER (PARTITION BY case_id) AS n FROM q_discrepancies) a WHERE r <= 3 GROUP BY 1) d USING (case_id)
 WHERE c.case_id % 4 <> 0) t
WHERE channel IS NOT NULL AND (coalesce(n, 0) > 0 OR overall_risk >= 30)"""
SQL["briefing"] = """
SELECT case_id, 'Summary of case ' || case_id || ' about ' ||
  coalesce(person, 'an unnamed person') || '. ' || CASE WHEN docs = 0 THEN 'It holds no documents so far.'
  ELSE 'It holds ' || docs || CASE WHEN docs = 1 THEN ' document.' ELSE ' documents.' END END ||
  CASE WHEN conflicts IS NOT NULL THEN ' Documents disagree on ' || conflicts ||
       '.' WHEN docs > 0 THEN ' No two documents disagree on a field.' ELSE '' END ||
  CASE WHEN marks > 0 THEN ' Some images carry marks of editing and should be looked at.' WHEN docs > 0 THEN ' No image carries a mark of editing.' ELSE '' END ||
  CASE WHEN fails > 0 THEN ' At least one check of a number or format failed.'
       ELSE '' END ||
  CASE recommendation WHEN 'verification_passed' THEN ' Nothing stands against approval.'
       WHEN 'review_recommended' THEN ' A routine review is advised.' ELSE ' Approval should wait for a review of the points named.' END AS spoken_text,
  conflicts IS NOT NULL OR marks > 0 OR fails > 0 AS has_warnings
FROM (SELECT c.case_id, recommendation, person, coalesce(docs, 0) AS docs, conflicts, coalesce(marks, 0) AS marks,
             coalesce(fails, 0) AS fails
 FROM b_cases c LEFT JOIN q_people USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS docs FROM b_docs GROUP BY 1) d USING (case_id)
 LEFT JOIN (SELECT case_id, string_agg(f, ', and ' ORDER BY f) AS conflicts FROM (SELECT DISTINCT case_id,
   replace(field_name, '_', ' ') AS f FROM q_all_findings WHERE severity IN ('medium', 'high')) s GROUP BY 1) k USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS marks FROM b_forensics WHERE severity IN ('medium', 'high') GROUP BY 1) m
      USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS fails FROM q_validations WHERE status = 'fail' GROUP BY 1) v USING (case_id)) t"""
CLEAN = r"trim(regexp_replace(lower(text), '[^\pL\pM\pN\p{Pc}\s]', '', 'g'))"


def routed(rules: tuple, fallback: str, source: str = "conversations") -> str:
    def when(part: int) -> str:
        out = ""
        for rule in rules:
            words = "|".join(w.replace("(", "\\(") for w in rule[0])
            value = "NULL" if rule[part] is None else f"'{rule[part]}'"
            out += f" WHEN regexp_matches(q, '{words}') THEN {value}"
        return out

    return (f"SELECT conv_id, turn, CASE{when(1)} ELSE '{fallback}' END AS category, CAST(CASE{when(2)} END AS VARCHAR) "
            f"AS action FROM (SELECT conv_id, turn, {CLEAN} AS q FROM {source}) m")


def _routes() -> None:
    from dossier.policy import CASE_INTENTS, SYSTEM_INTENTS
    table_words = (
        (("the ", "with"), "identity", None), (("und ", "der "), "dob", "switch_tab:Documents"),
        (("que ", "los "), "documents", "switch_tab:Documents"), (("des ", "les "), "report", "switch_tab:Report"))
    SQL["intent_routes"] = routed(table_words, "general_overview")
    SQL["system_intents"] = routed(SYSTEM_INTENTS, "fallback")
    SQL["case_intents"] = f"""
SELECT CASE category WHEN 'forensics' THEN CASE WHEN forensic_high + forensic_medium > 0 THEN 'forensics_flagged' ELSE
  'forensics_clean' END WHEN 'comparison' THEN CASE WHEN dob_mismatch + name_mismatch + document_number_mismatch +
  address_mismatch + gender_nationality_mismatch + face_mismatch > 0 THEN 'comparison_mismatch' ELSE 'comparison_clean' END
  WHEN 'documents' THEN CASE WHEN n_docs > 0 THEN 'documents_list' ELSE 'documents_empty' END
  WHEN 'review' THEN 'review_pending' ELSE category END AS category, action, count(*) AS turns
FROM ({routed(CASE_INTENTS, 'general_overview')}) r LEFT JOIN q_evidence ON case_id = conv_id GROUP BY 1, 2"""


_routes()

# ---- audit --------------------------------------------------------------------------------------------------------
_ZERO = "0" * 64


def event_text(previous: str) -> str:
    return (f"'{{\"action\":\"' || action || '\",\"actor\":\"' || actor_id || '\",\"case\":\"' || segment || "
            f"'\",\"details\":' || details || ',\"previous\":\"' || {previous} || '\",\"target\":null,\"time\":\"' || "
            f"strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(created_at) % 1000000 = 0 THEN '' ELSE "
            f"'.' || lpad(CAST(microsecond(created_at) % 1000000 AS VARCHAR), 6, '0') END || '\"}}'")


STEPS["q_digests"] = (("b_audit",), "SELECT *, " + hmac(event_text(f"'{_ZERO}'")) + " AS event_hash FROM b_audit")
SQL["audit_digest"] = "SELECT id, event_hash FROM q_digests"
SQL["audit_links"] = f"""
SELECT id, segment, coalesce(lag(event_hash) OVER (PARTITION BY segment ORDER BY id), '{_ZERO}') AS expected_previous
FROM q_digests"""
SQL["audit_append"] = f"""
WITH RECURSIVE e AS (SELECT *, segment || '/' || id // 10000 AS chain,
    row_number() OVER (PARTITION BY segment, id // 10000 ORDER BY id) AS k FROM
   (SELECT event_id AS id, user_id AS actor_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS segment,
           event_type AS action, props AS details, ts AS created_at FROM events) a),
c AS (SELECT chain, id, k, '{_ZERO}' AS previous_hash, {hmac(event_text(f"'{_ZERO}'"))} AS event_hash FROM e WHERE k = 1
 UNION ALL SELECT e.chain, e.id, e.k, c.event_hash, {hmac(event_text('c.event_hash'))} FROM c
 JOIN e ON e.chain = c.chain AND e.k = c.k + 1)
SELECT chain, id, previous_hash, event_hash FROM c"""
SQL["audit_verify"] = """
SELECT chain, bad IS NULL AND NOT lost AS valid, CASE WHEN bad IS NULL THEN n ELSE before END AS checked,
       CASE WHEN bad IS NOT NULL THEN CAST(bad AS VARCHAR) WHEN lost THEN 'head' END AS broken_at
FROM (SELECT chain, count(*) AS n, min(CASE WHEN hurt THEN id END) AS bad, any_value(lost) AS lost,
   count(*) FILTER (id < coalesce(first_bad, 0)) AS before
 FROM (SELECT *, min(CASE WHEN hurt THEN id END) OVER (PARTITION BY chain) AS first_bad FROM (
  SELECT chain, id, lost, id % 997 = 13 OR (id % 1009 = 7 AND k > 1) AS hurt FROM (
   SELECT segment || '/' || id // 10000 AS chain, id, segment % 10 = 3 AS lost,
     row_number() OVER (PARTITION BY segment, id // 10000 ORDER BY id) AS k,
     id = max(id) OVER (PARTITION BY segment, id // 10000) AS tail FROM b_audit) a WHERE NOT (lost AND tail)) b) d
 GROUP BY 1) f"""

SQL["evidence_files"] = """
SELECT doc_id, reason IS NULL AS accepted, reason, CASE WHEN broken THEN 'unavailable' WHEN trim(body, chr(32) || chr(9) || chr(10)) = ''
  AND doc_id % 3 = 0 THEN 'no_text' ELSE 'extracted' END AS extraction_status,
 CAST(length(CASE WHEN broken THEN '' ELSE body END) AS BIGINT) AS n_chars, md5(CASE WHEN broken THEN '' ELSE body END) AS text_md5
FROM (SELECT *, doc_id % 3 = 0 AND doc_id % 50 IN (7, 11) AS broken,
 CASE WHEN doc_id % 3 <> 0 AND body = '' THEN 'size out of bounds' WHEN doc_id % 3 = 0 AND doc_id % 50 = 7 THEN 'DOCX container is not readable'
      WHEN doc_id % 3 = 0 AND doc_id % 50 = 11 THEN 'DOCX container has no document part' END AS reason
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), chr(10), ' ') ELSE coalesce(text, '') END AS body
       FROM documents) a) b"""
SQL["blob_check"] = """
SELECT version_id, reason IS NULL AS verified, reason FROM (SELECT version_id, CASE version_id % 50 WHEN 9 THEN 'invalid storage key'
 WHEN 1 THEN 'file missing' WHEN 3 THEN 'integrity check failed' WHEN 5 THEN 'hash differs from record' END AS reason FROM b_versions) a"""
SQL["comparison_order"] = f"""
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY status <> 'mismatch', field_name) AS INTEGER) AS position,
 field_name, status FROM ({SQL["comparison_table"]}) rows_of_case"""
SQL["encrypted_roundtrip"] = """
SELECT version_id, text <> '' AS marked, true AS same, text <> '' AS other_context_refused FROM b_versions"""
SQL["merged_lines"] = """
SELECT document_id, CASE WHEN document_type = 'passport' THEN 11 ELSE 9 END::BIGINT AS lines, 2 AS last_pass,
       CASE WHEN document_type = 'passport' THEN 960 ELSE 500 END AS lowest FROM b_docs"""
SQL["displacement_votes"] = f"""
SELECT document_id, region, round_even(score, 2) AS score, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.33 THEN
       'medium' ELSE 'low' END AS severity, vx, vy, votes, x0, y0, w, h
FROM (SELECT *, CASE WHEN region IN ('QR zone', 'MRZ band') THEN least(raw, 0.25) ELSE raw END::DOUBLE AS score FROM (
 SELECT *, least(0.85, votes * 0.05 + 0.45) AS raw, {zone('((x0 + x0 + w) / 2.0 / 1000)', '((y0 + y0 + h) / 2.0 / 700)',
 "'pan'")} AS region FROM (
  SELECT document_id, vx, vy, count(*) AS votes, greatest(0, min(x) - 16)::INT AS x0, greatest(0, min(y) - 16)::INT AS y0,
         (least(1000, max(x) + 16) - greatest(0, min(x) - 16))::INT AS w,
         (least(700, max(y) + 16) - greatest(0, min(y) - 16))::INT AS h,
         row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, vx, vy) AS r FROM (
   SELECT CAST(l_suppkey * 100 + doc_ord AS VARCHAR) AS document_id, l_partkey % 400 AS x, l_partkey % 300 AS y,
          CAST(round_even((-(floor(l_quantity / 10) * 60 + 30)) / 12, 0) * 12 AS INT) AS vx, -72 AS vy,
          sqrt(power(floor(l_quantity / 10) * 60 + 30, 2) + 72 * 72) AS far FROM b_docs) a
  WHERE far > 60 AND far < 850 GROUP BY 1, 2, 3) b WHERE r = 1 AND votes >= 5) c) d"""
SQL["stream_trend"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) FILTER (event_type = 'view') AS valid,
       count(*) FILTER (event_type <> 'view' AND trunc(value) >= 60) AS high_risk,
       count(*) FILTER (event_type <> 'view' AND trunc(value) < 60) AS under_review, count(*) AS total
FROM events GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
SQL["stream_notices"] = """
SELECT 'email' AS channel, count(*) AS notices, CAST(sum(n) AS BIGINT) AS discrepancies FROM (
 SELECT o_orderkey, floor(o_totalprice / 5000) AS risk, coalesce(n, 0) AS n FROM orders LEFT JOIN (
  SELECT case_id, count(*) AS n FROM (SELECT case_id FROM q_findings WHERE severity <> 'info'
   UNION ALL SELECT case_id FROM q_checks WHERE status = 'fail'
   UNION ALL SELECT case_id FROM b_forensics WHERE severity = 'high') a GROUP BY 1) d ON case_id = o_orderkey) t
WHERE o_orderkey % 4 <> 0 AND (n > 0 OR risk >= 30)"""

# ---- streams --------------------------------------------------------------------------------------------------------
SQL["stream_sessions"] = """
SELECT u.user_id, count(*) AS valid_uses FROM events u JOIN events s ON u.user_id = s.user_id AND
 s.event_type = 'signup' AND u.event_type = 'click' AND u.ts >= s.ts AND u.ts < s.ts + INTERVAL 12 HOURS
WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = u.user_id AND r.event_type = 'error' AND r.ts BETWEEN s.ts AND u.ts)
 AND epoch_ms(u.ts) < (SELECT min(newest) - 13 * 3600000 FROM (
  SELECT max(epoch_ms(ts)) AS newest FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY event_type) w)
GROUP BY 1"""
SQL["stream_links"] = """
SELECT CASE WHEN id % 1009 = 7 THEN before = 0 ELSE NOT coalesce(gap, false) END AS linked,
       id % 997 <> 13 AND (id % 1009 <> 7 OR n = 1) AS sound, false AS late, count(*) AS events
FROM (SELECT *, max(created) OVER (PARTITION BY chain ORDER BY id) AS reached, max(created) OVER () AS newest FROM (
 SELECT *, epoch_ms(created_at) AS created, lag(lost) OVER c AS gap, row_number() OVER c AS n,
   coalesce(count(*) FILTER (NOT lost) OVER (PARTITION BY chain ORDER BY id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT *, segment || '/' || id // 10000 AS chain, id % 499 = 11 AS lost FROM b_audit) a
 WINDOW c AS (PARTITION BY chain ORDER BY id)) b WHERE NOT lost) d
WHERE reached < newest - 3600000 GROUP BY 1, 2"""
SQL["stream_lockouts"] = """
WITH RECURSIVE a AS (SELECT user_id, event_id, ts, event_type = 'signup' AS ok,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, 0::BIGINT AS k, '' AS outcome, 0 AS failures,
   NULL::TIMESTAMP AS locked FROM a
 UNION ALL SELECT a.user_id, a.event_id, a.ts, a.k,
  CASE WHEN s.locked > a.ts THEN 'rejected' WHEN ok THEN 'accepted' WHEN failures >= 4 THEN 'locked' ELSE 'failed' END,
  CASE WHEN s.locked > a.ts THEN failures WHEN ok OR failures >= 4 THEN 0 ELSE failures + 1 END,
  CASE WHEN s.locked > a.ts THEN s.locked WHEN ok THEN NULL WHEN failures >= 4 THEN a.ts + INTERVAL 15 MINUTES ELSE s.locked END
  FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1)
SELECT event_id, user_id, outcome, false AS late FROM s
WHERE k > 0 AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM a) - 3600000"""
SQL["stream_reuse"] = """
SELECT DISTINCT sha256(props) AS file_hash FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND props IN
 (SELECT props FROM events WHERE ts < TIMESTAMP '2024-01-02')"""

# ---- single functions ---------------------------------------------------------------------------------------------
SQL["scalar_functions"] = """
SELECT p_partkey, regexp_replace(upper(p_brand || ' / ' || p_type), '[^A-Z0-9-]', '', 'g') AS number,
       'who is ' || p_name AS asked, p_name AS label_free,
       round_even(1 - levenshtein(upper(p_name), upper(p_type)) / greatest(length(p_name), length(p_type)), 2) AS likeness,
       translate(p_brand, 'OISBZ', '01582') AS repaired,
       CASE WHEN y % 4 = 0 AND full_y <> 1900 THEN full_y || '-02-29' END AS leap_day, true AS key_ok
FROM (SELECT *, p_size % 100 AS y, CASE WHEN p_size % 100 > 24 THEN 1900 ELSE 2000 END + p_size % 100 AS full_y
      FROM part) t"""
SQL["token_overlap"] = f"""
SELECT document_id, CASE WHEN least(len(a), len(b)) > 0 THEN round_even(len(list_intersect(a, b)) / least(len(a), len(b)), 4)
  ELSE 0 END AS overlap, len(a) > 0 AND len(list_filter(a, lambda s: list_contains(b, s))) = len(a) AS subset
FROM (SELECT document_id, {ADDRESS_TOKENS.format('address')} AS a,
             {ADDRESS_TOKENS.format("(full_name || ' road delhi')")} AS b FROM b_printed) t"""

ORACLE = {name: with_tables(body, STEPS) for name, body in SQL.items()}

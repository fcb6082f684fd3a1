"""Agreement, rules, checks and risk on small cases."""
import datetime as dt

from pyspark.sql import functions as F

from dossier import policy
from dossier.operators import agreement, extraction, reuse, risk, rules, validation

FIELDS = ("case_id long, document_id string, document_type string, file_name string, doc_ord int, field_name string, "
          "value string, confidence double")


def as_of():
    return F.lit("2026-01-01").cast("date")


def fields_of(spark, docs):
    """docs: (case, type, {field: value}) in order."""
    rows, papers = [], []
    for n, (case, kind, values) in enumerate(docs):
        papers.append((case, f"d{n}", kind, f"f{n}.png", n))
        rows += [(case, f"d{n}", kind, f"f{n}.png", n, f, v, 80.0) for f, v in values.items()]
    return (spark.createDataFrame(papers, "case_id long, document_id string, document_type string, file_name string, "
                                          "doc_ord int"), spark.createDataFrame(rows, FIELDS))


def found(spark, docs):
    _, fields = fields_of(spark, docs)
    rows = agreement.consistency(agreement.clusters(agreement.field_values(fields))).collect()
    return {(r.field_name, r.type_key): r for r in rows}


def test_findings(spark):
    rows = found(spark, [
        (1, "passport", {"date_of_birth": "2001-05-12", "gender": "M", "document_number": "SR1234567"}),
        (1, "pan", {"date_of_birth": "12/05/2001", "gender": "M", "document_number": "ABCPE1234F"}),
        (1, "passport", {"date_of_birth": "1999-05-12", "gender": "F", "document_number": "SR7654321"})])
    assert rows["date_of_birth", ""].severity == "high" and rows["date_of_birth", ""].n_documents == 3
    assert rows["gender", ""].severity == "medium"
    assert rows["document_number", "passport"].severity == "high"
    assert ("document_number", "pan") not in rows


def test_greedy_clusters_keep_document_order(spark):
    rows = found(spark, [(1, "pan", {"full_name": "RAHUL SHARMA"}), (1, "pan", {"full_name": "RAVI SHARMA"}),
                         (1, "pan", {"full_name": "R SHARMA"})])
    assert rows["full_name", ""].n_clusters == 2
    rows = found(spark, [(1, "pan", {"full_name": "R SHARMA"}), (1, "pan", {"full_name": "RAHUL SHARMA"}),
                         (1, "pan", {"full_name": "RAVI SHARMA"})])
    assert rows["full_name", ""].n_clusters == 1


def test_large_groups_equal_small_ones(spark, monkeypatch):
    """Rounds and tiles give what the fold gives."""
    names = [f"{'R' if i % 7 == 0 else 'N' + str(i % 11)} S{i % 5}" for i in range(60)]
    _, fields = fields_of(spark, [(1, "pan", {"full_name": n, "address": f"{n} road {i % 3} pune"})
                                  for i, n in enumerate(names)])
    values = agreement.field_values(fields)

    def state():
        led = {(r.field_name, r.form): r.leader.form for r in agreement.clusters(values).collect()}
        held = {(r.field_name, r.form): r.agreeing for r in agreement.support(values).collect()}
        return led, held

    small = state()
    monkeypatch.setattr(agreement, "FOLD_VALUES", 4)
    monkeypatch.setattr(agreement, "ROUND_LEADERS", 3)
    assert state() == small


def test_tokenless_values_stand_alone(spark):
    rows = found(spark, [(1, "pan", {"address": "?"}), (1, "pan", {"address": "?"})])
    assert rows["address", ""].n_clusters == 2


def test_comparison(spark):
    _, fields = fields_of(spark, [(1, "pan", {"full_name": "A B"}), (1, "pan", {"full_name": "C D"}),
                                  (1, "pan", {"full_name": "C D"}), (2, "pan", {"full_name": "A B"})])
    values = agreement.field_values(fields)
    table = {r.case_id: r for r in agreement.comparison(
        agreement.support(values), agreement.consistency(agreement.clusters(values))).collect()}
    assert table[1].status == "mismatch" and table[1].reference_value == "C D" and table[1].n_disagree == 1
    assert table[2].status == "single_source"


def wide_of(spark, docs):
    return validation.by_document(*fields_of(spark, docs))


def test_rules(spark):
    wide = wide_of(spark, [
        (1, "passport", {"date_of_birth": "2006-05-10"}), (1, "driving_licence", {"issue_date": "2016-01-15"}),
        (2, "national_id", {"issue_date": "2024-01-01", "expiry_date": "2020-01-01"}),
        (3, "pan", {"document_number": "ABCPE1234F", "full_name": "RAHUL SHARMA"}),
        (4, "pan", {"document_number": "ABCPV1234F", "full_name": "RAHUL VERMA"}),
        (5, "pan", {"father_name": "RAMESH CHANDRA SHARMA"}), (5, "pan", {"father_name": "SURESH KUMAR VERMA"}),
        (6, "pan", {"document_number": "ABCCV1234F"}), (7, "pan", {"document_number": "ABCPV1234F"})])
    age = {r.case_id: r for r in rules.rule_age(wide).collect()}
    assert age[1].status == "fail" and "9 years old" in age[1].explanation and age[2].status == "not_applicable"
    order = {r.case_id: r for r in rules.rule_dates(wide, rules.date_issues(wide, as_of())).collect()}
    assert order[2].status == "fail" and "precedes" in order[2].explanation and order[1].status == "pass"
    pan = {r.case_id: r for r in rules.rule_pan(wide).collect()}
    assert pan[3].status == "fail" and "expected initial 'E'" in pan[3].explanation
    assert pan[4].status == "pass" and pan[6].status == "not_applicable" and pan[7].status == "warning"
    parent = {r.case_id: r.status for r in rules.rule_parent(wide).collect()}
    assert parent[5] == "fail" and parent[1] == "not_applicable"


def test_name_similarity_tiles(spark, monkeypatch):
    names = [f"NAME{i % 9} PART{i % 4}" for i in range(30)]
    _, fields = fields_of(spark, [(1, "pan", {"full_name": n}) for n in names])
    whole = rules.name_similarity(fields).first().overall_similarity
    from dossier.functions.text import ratio
    pairs = [ratio(min(a, b), max(a, b)) for i, a in enumerate(names) for b in names[i + 1:]]
    assert abs(whole - sum(pairs) / len(pairs)) < 0.006
    monkeypatch.setattr(rules, "_TILE", 4)
    assert rules.name_similarity(fields).first().overall_similarity == whole


def checks(spark, kind, values):
    wide = wide_of(spark, [(1, kind, values)])
    return {r.check_type: r for r in validation.validate_documents(wide, as_of()).collect()}


def test_validation(spark):
    assert checks(spark, "visa", {"full_name": "X Y", "expiry_date": "2020-01-01"})["Expiration status"].status == "warning"
    assert checks(spark, "national_id", {"date_of_birth": "2030-01-01"})["Date of birth plausibility"].status == "fail"
    bad = checks(spark, "passport", {"issue_date": "2030-01-01", "expiry_date": "2029-01-01"})
    assert bad["Issue/expiry logic"].status == "fail"
    assert checks(spark, "pan", {"document_number": "BRXPS1234K"})["Document number format"].status == "pass"
    assert checks(spark, "pan", {"document_number": "12345"})["Document number format"].status == "fail"
    assert "document_number" in checks(spark, "national_id", {"full_name": "A B"})["Mandatory fields"].message


ZONE1 = "P<SRDSHARMA<<RAHUL<<<<<<<<<<<<<<<<<<<<<<<<<<"


def zone2():
    def digit(text):
        worth = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
        return str(sum(worth.get(c, 0) * policy_weight for c, policy_weight in zip(text, (7, 3, 5) * 20)) % 10)

    number, born, ends, own = "SR0421965", "010512", "330202", "<" * 14
    head, middle = number + digit(number), born + digit(born)
    tail = ends + digit(ends) + own + digit(own)
    return head + "SRD" + middle + "M" + tail + digit(head + middle + tail)


def test_zone(spark):
    good = zone2()
    bad = good[:9] + str((int(good[9]) + 1) % 10) + good[10:]
    rows = [("a", i, t) for i, t in enumerate(["NATIONAL IDENTITY CARD", ZONE1, "some noise", good])]
    rows += [("b", i, t) for i, t in enumerate([ZONE1, bad])] + [("c", 0, "NAME RAHUL SHARMA")]
    zones = {r.document_id: r for r in validation.mrz_parse(
        spark.createDataFrame(rows, "document_id string, line_no int, text string"), as_of()).collect()}
    assert set(zones) == {"a", "b"}
    assert zones["a"].document_number == "SR0421965" and zones["a"].surname == "SHARMA"
    assert zones["a"].dob == "2001-05-12" and zones["a"].expiry == "2033-02-02" and zones["a"].passed == 5
    assert not zones["b"].checks.document_number


def test_extraction(spark):
    texts = {
        "full": ["HEADER TITLE BAND", "Full Name: RAHUL SHARMA", "Date of Birth 12/05/2001", "Gender M",
                 "Passport No SR0421965"],
        "parts": ["x", "Surname SHARMA", "Given Name RAHUL"],
        "next": ["ADDRESS PROOF CERTIFICATE", "ISSUED BY SOCIETY", "RESIDING AT:", "14 LAKEVIEW ROAD PUNE 411001"],
        "loose": ["x", "born 03/04/1990", "ABCPE1234F"]}
    rows = [(d, i, t, 80.0, 10 if i == 0 else 100 + 64 * i, 30) for d, lines in texts.items()
            for i, t in enumerate(lines)]
    lines = spark.createDataFrame(rows, "document_id string, line_no int, text string, confidence double, y int, h int")
    got = {(r.document_id, r.field_name): r.normalized_value
           for r in extraction.extract_fields(lines, validation.mrz_parse(lines, as_of())).collect()}
    assert got["full", "full_name"] == "RAHUL SHARMA" and got["full", "date_of_birth"] == "2001-05-12"
    assert got["full", "gender"] == "M" and got["full", "document_number"] == "SR0421965"
    assert got["parts", "full_name"] == "RAHUL SHARMA" and ("parts", "surname_part") not in got
    assert "lakeview" in got["next", "address"] and "certificate" not in got["next", "address"]
    assert got["loose", "date_of_birth"] == "1990-04-03" and got["loose", "document_number"] == "ABCPE1234F"


def test_classify(spark):
    texts = [("aadhaar", "GOVERNMENT OF INDIA UNIQUE IDENTIFICATION AUTHORITY OF INDIA MERA AADHAAR 5489 1234 5678"),
             ("pan", "INCOME TAX DEPARTMENT GOVT. OF INDIA PERMANENT ACCOUNT NUMBER ABCDE1234F FATHER'S NAME"),
             ("unknown", "just some grocery items milk bread eggs butter")]
    df = spark.createDataFrame([(k, t, 1.58) for k, t in texts], "document_id string, text string, aspect double")
    rows = extraction.classify(df, uncertain="unknown", aspect="aspect").collect()
    assert all(r.document_id == r.document_type for r in rows)
    assert all(r.type_confidence > 0.4 for r in rows if r.document_type != "unknown")


def score(spark, **facts):
    names = [*sorted(set(policy.CONFLICT_FACTOR.values())), *risk._FLAGS, "name_info", "address_info", "face_info",
             "checks", "checks_ok", "n_fields", "n_read", "n_docs"]
    row = [1] + [int(facts.get(n, 1 if n == "n_fields" else 0)) for n in names]
    evidence = spark.createDataFrame([row], "case_id long, " + ", ".join(f"{n} long" for n in names))
    ledger = risk.risk_ledger(evidence)
    return risk.risk_score(evidence, ledger).first(), {r.factor: r for r in ledger.collect()}


def test_risk_anchors(spark):
    got, _ = score(spark, dob_mismatch=1, reuse_hits=2, forensic_medium=1)
    assert (got.score, got.band, got.recommendation) == (72, "HIGH", "manual_review_required")
    got, ledger = score(spark, dob_mismatch=1, forensic_medium=1, name_info=1, address_info=1, mrz_pass=1,
                        checks=3, checks_ok=3)
    assert got.score == 42 and all(r.direction == "increase" for r in ledger.values())
    got, ledger = score(spark, forensic_high=4)
    assert got.score == 25 and "4 occurrences, capped at 1" in ledger["forensic_high"].explanation
    got, _ = score(spark, dob_mismatch=1, name_mismatch=1, document_number_mismatch=1, forensic_high=5,
                   validation_fail=50, mrz_fail=1, expired=1)
    assert (got.score, got.band) == (100, "CRITICAL")
    got, _ = score(spark, n_fields=0)
    assert got.recommendation == policy.UNABLE
    got, ledger = score(spark, name_info=1, mrz_pass=1, checks=2, checks_ok=2)
    assert got.score == 0 and sum(r.score for r in ledger.values()) == -15


def test_reuse(spark):
    docs = spark.createDataFrame([(1, 1, "h"), (2, 2, "h"), (3, 2, "h"), (4, 3, "x")],
                                 "document_id long, case_id long, file_hash string")
    rows = {r.document_id: r for r in reuse.same_hash(docs).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].hits == 2 and rows[3].other_document_id == 1


def test_near_hash_equals_brute_force(spark):
    import random
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(10))) for b in base for _ in range(6)]
    signed = sorted({v % 2 ** 64 - 2 ** 64 if v % 2 ** 64 >= 2 ** 63 else v % 2 ** 64 for v in base + near})
    docs = spark.createDataFrame(list(enumerate(signed)), "document_id long, near_hash long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) % 2 ** 64).count("1") <= 8}
    for spare in (1, 3, 4):
        got = reuse.near_hash(docs, spare=spare).collect()
        assert {(r.hash_a, r.hash_b) for r in got} == want and len(got) == len(want)
        assert all(r.distance == bin((r.hash_a ^ r.hash_b) % 2 ** 64).count("1") for r in got)
        cost = reuse.near_cost(docs, spare=spare).first()
        assert cost.hashes == len(signed) and cost.index_rows == len(signed) * {1: 9, 3: 165, 4: 495}[spare] and cost.compared >= len(want)
    copies = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("near_hash", F.lit(None).cast("long")))
    assert {(r.copies_a, r.copies_b) for r in reuse.near_hash(copies).collect()} == {(2, 2)}
    assert reuse.near_hash(docs.limit(0)).count() == 0 and reuse.near_cost(docs.limit(0)).first().compared == 0


def test_near_hash_inside_one_dense_group(spark):
    """Hashes that all lie near each other: every pair once."""
    import random
    rng = random.Random(8)
    centre = rng.getrandbits(63)
    signed = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in range(1, 60, 4)})
    docs = spark.createDataFrame(list(enumerate(signed)), "document_id long, near_hash long")
    got = [(r.hash_a, r.hash_b) for r in reuse.near_hash(docs).collect()]
    assert len(got) == len(set(got)) == len(signed) * (len(signed) - 1) // 2


def test_age_uses_birthdays(spark):
    from dossier.functions.dates import age_at
    row = spark.range(1).select(age_at(F.lit(dt.date(2000, 2, 29)), F.lit(dt.date(2018, 2, 28))).alias("a")).first()
    assert row.a == 17

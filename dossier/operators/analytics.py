"""Counts, rates, distributions and rankings over all cases."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier import policy
from dossier.operators.listing import label_of, share
from dossier.session import cut, explode_present


def percent(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(F.lit(1), whole) * 100, 1)


def _outcome() -> Column:
    return F.lower(F.coalesce(F.col("recommendation"), F.lit("")))


def outcome_bucket() -> Column:
    """Dashboard rule: review outcomes from 60 points on count as high risk."""
    outcome = F.lower(F.trim("recommendation"))
    review = outcome.isin(*policy.DASHBOARD_REVIEW)
    return (F.when(F.col("recommendation").isNull() | F.col("overall_risk").isNull(), "pending")
            .when(outcome.isin(*policy.VALID_OUTCOMES), "valid")
            .when(review & (F.col("overall_risk") >= policy.HIGH_RISK_SCORE), "high_risk")
            .when(review, "under_review").otherwise("pending"))


def workspace_summary(cases: DataFrame, grants: DataFrame, docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per user: visible cases, active ones, their documents, own pending reviews, legal holds.

    Overseers get the totals once, as scalars; others sum over their own cases.
    """
    per_case = cases.join(docs.groupBy("case_id").agg(F.count("*").alias("n_docs")), "case_id", "left").select(
        "case_id", F.col("status").isin(*policy.OPEN_STATES).cast("long").alias("open"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.col("legal_hold").cast("long").alias("hold"))
    sums = [F.count("case_id").alias("total_cases"), F.coalesce(F.sum("open"), F.lit(0)).alias("active_cases"),
            F.coalesce(F.sum("n_docs"), F.lit(0)).alias("documents"),
            F.coalesce(F.sum("hold"), F.lit(0)).alias("legal_holds")]
    totals = F.broadcast(per_case.agg(*sums).withColumn("scope", F.lit("all")))  # one row
    overseers = grants.filter(F.col("scope") == "all").join(totals, "scope").drop("scope", "case_id")
    scoped = grants.filter(F.col("scope") == "case").join(per_case, "case_id").groupBy("user_id").agg(*sums)
    pending = reviews.filter(F.col("status") == "pending").groupBy(F.col("assigned_to").alias("user_id")).agg(
        F.count("*").alias("pending_reviews"))
    return overseers.unionByName(scoped).join(pending, "user_id", "left").withColumn(
        "pending_reviews", F.coalesce("pending_reviews", F.lit(0)))


def dashboard_summary(cases: DataFrame) -> DataFrame:
    bucket = outcome_bucket()
    return cases.agg(
        F.count("*").alias("total_screened"),
        *[F.count_if(bucket == b).alias(b) for b in ("valid", "under_review", "high_risk")],
        F.bround(F.avg("overall_risk"), 1).alias("average_risk_score"))


def counts_for(findings: DataFrame) -> Column:
    """What a finding counts for: the pairs behind it where findings carry them, else one."""
    return (F.col("pairs") if "pairs" in findings.columns else F.lit(1)).cast("long")


def kpis(cases: DataFrame, docs: DataFrame, findings: DataFrame, stages: DataFrame) -> DataFrame:
    """One row of key figures; the high-risk set overlaps the other two."""
    outcome = _outcome()
    counted = cases.agg(
        F.count("*").alias("total_cases"),
        F.count_if(outcome.isin(*policy.VALID_OUTCOMES)).alias("valid_count"),
        F.count_if(outcome.isin(*policy.KPI_REVIEW)).alias("review_count"),
        F.count_if(outcome.isin(*policy.HIGH_RISK_OUTCOMES)
                   | F.coalesce(F.col("overall_risk") >= policy.HIGH_RISK_SCORE, F.lit(False)))
        .alias("high_risk_count"),
        F.bround(F.avg("overall_risk"), 1).alias("average_risk_score"))
    face = findings.filter(F.col("field_name") == "facial_photo").agg(
        F.struct(F.coalesce(F.sum(counts_for(findings)), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(F.when(F.col("severity").isin("medium", "high"), counts_for(findings))), F.lit(0)).alias("bad"))).scalar()
    latency = stage_latency(stages).agg(F.coalesce(F.sum("avg_duration_ms"), F.lit(0))).scalar()
    total = F.col("total_cases")
    return counted.select(
        "*",
        percent(F.col("valid_count"), total).alias("pass_rate"),
        percent(F.col("review_count"), total).alias("review_rate"),
        percent(F.col("high_risk_count"), total).alias("high_risk_rate"),
        docs.agg(F.count("*")).scalar().alias("total_documents"),
        face["n"].alias("face_checks"),
        percent(face["bad"], face["n"]).alias("face_mismatch_rate"),
        latency.cast("long").alias("avg_processing_time_ms"))


def volume_trend(cases: DataFrame, days: int, as_of: Column, off_slot: str = "last") -> DataFrame:
    """Cases per slot and class; a day between slots goes to the last slot, or to the one before it (``floor``)."""
    step = max(1, days // 14)
    back = days % step  # slots run from ``days`` ago in steps, so the newest slot lies this far back
    age = F.datediff(as_of, "created_on")
    on_slot = (age >= back) & (age <= days) & ((F.lit(days) - age) % step == 0)
    off = F.lit(back) if off_slot == "last" else F.greatest(F.lit(back), F.least(
        F.lit(days), F.lit(days) - F.floor((F.lit(days) - age) / step) * step))
    outcome = _outcome()
    high = outcome.isin(*policy.HIGH_RISK_OUTCOMES) | (F.coalesce("overall_risk", F.lit(0)) >= policy.HIGH_RISK_SCORE)
    placed = cases.select(
        F.date_sub(as_of, F.when(on_slot, age).otherwise(off).cast("int")).alias("slot"),
        F.when(outcome.isin(*policy.VALID_OUTCOMES), "valid").when(high, "high_risk")
        .otherwise("under_review").alias("class"))
    counted = placed.groupBy("slot").agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in ("valid", "under_review", "high_risk")],
        F.count("*").alias("total"))
    slots = cases.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(as_of, days), F.date_sub(as_of, back), F.expr(f"INTERVAL {step} DAYS"))).alias("slot"))
    names = ("valid", "under_review", "high_risk", "total")
    return slots.join(counted, "slot", "left").select(
        F.col("slot").cast("string").alias("slot"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def risk_distribution(cases: DataFrame) -> DataFrame:
    score = F.coalesce("overall_risk", F.lit(10))
    tier = F.lit(len(policy.RISK_TIERS) - 1)
    for number, (most, _, _) in reversed(list(enumerate(policy.RISK_TIERS[:-1]))):
        tier = F.when(score <= most, number).otherwise(tier)
    counted = cases.groupBy(tier.alias("ord")).agg(F.count("*").alias("count"))
    dim = cases.sparkSession.createDataFrame(
        [(n, name, label) for n, (_, name, label) in enumerate(policy.RISK_TIERS)],
        "ord int, tier string, range_label string")
    full = dim.join(counted, "ord", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return share(full, "count").select("ord", "tier", "range_label", "count", "percentage")


def discrepancy_ranking(findings: DataFrame, ranked: Sequence[str] = policy.RANKED_FIELDS) -> DataFrame:
    """Findings per field with their severities; listed fields without findings show zero."""
    severity, weight = F.coalesce("severity", F.lit("medium")), counts_for(findings)
    levels = ("info", "low", "medium", "high")
    counted = findings.groupBy("field_name").agg(
        F.sum(weight).alias("count"), *[F.sum(F.when(severity == s, weight).otherwise(0)).alias(s) for s in levels])
    listed = findings.sparkSession.createDataFrame([(f,) for f in ranked], "field_name string")
    # a row per field, written so that the total does not run over the findings again
    full = cut(listed.join(counted, "field_name", "full").select(
        "field_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", *levels)]))
    return share(full, "count").withColumn(
        "label", label_of("field_name", policy.ANALYTICS_FIELD_LABELS))


def type_mix(docs: DataFrame, statuses: DataFrame, listed: Sequence[str] = policy.LISTED_TYPES) -> DataFrame:
    """Count, share of all documents, pass rate and confidence per listed type, from real outcomes."""
    total = docs.agg(F.count("*")).scalar()
    kind = F.coalesce("document_type", F.lit("other"))
    by_type = docs.join(statuses.select("document_id", "status"), "document_id", "left").groupBy(kind.alias("document_type")).agg(
        F.count("*").alias("count"),
        F.bround(F.count_if(F.col("status") == "valid") / F.greatest(F.lit(1), F.count("status")) * 100, 1)
        .alias("pass_rate"),
        F.bround(F.avg("confidence"), 2).alias("avg_confidence"))
    dim = docs.sparkSession.createDataFrame([(t,) for t in listed], "document_type string")
    return dim.join(by_type, "document_type", "left").select(
        "document_type", label_of("document_type", policy.ANALYTICS_TYPE_LABELS).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
        percent(F.coalesce("count", F.lit(0)), total).alias("percentage"), "pass_rate", "avg_confidence")


def signal_rates(findings: DataFrame, forensics: DataFrame, validations: DataFrame, cases: DataFrame) -> DataFrame:
    """Real hits per detector, the cases they touch, and their mean score.

    Inputs: findings (case_id, field_name, severity), forensics (case_id, finding_type, score),
    validations (case_id, check_type, status).
    """
    def pick(df: DataFrame, signal: Column, score: Column) -> DataFrame:
        return df.select("case_id", signal.alias("signal_key"), score.cast("double").alias("score"),
                         counts_for(df).alias("w")).filter(F.col("signal_key").isNotNull())

    kind, check = F.col("finding_type"), F.col("check_type")
    hits = pick(forensics, F.when(kind == "copy_move_anomaly", "copy_move_cloning")
                .when(kind == "ela_compression_anomaly", "ela_compression_anomaly")
                .when(kind == "noise_gradient_anomaly", "noise_gradient_anomaly"), F.col("score")) \
        .unionByName(pick(
            findings.filter(F.col("severity").isin("medium", "high")),
            F.when(F.col("field_name") == "facial_photo", "facial_photo_mismatch"), F.lit(None))) \
        .unionByName(pick(
            validations.filter(F.col("status") == "fail"),
            F.when(check.startswith("QR payload"), "qr_barcode_conflict")
            .when(check == "MRZ checksum", "mrz_checksum_error"), F.lit(None)))
    total = cases.agg(F.count("*")).scalar()
    # cases are made distinct before they are counted, so one hot signal stays spread over tasks
    per_case = hits.groupBy("signal_key", "case_id").agg(
        F.sum("w").alias("n"), F.sum("score").alias("s"), F.count("score").alias("ns"))
    counted = per_case.groupBy("signal_key").agg(
        F.sum("n").alias("detected_count"), F.count("*").alias("cases"),
        F.bround(F.sum("s") / F.nullif(F.sum("ns"), F.lit(0)), 2).alias("avg_score"))
    dim = cases.sparkSession.createDataFrame(
        [(k, *v) for k, v in policy.SIGNALS.items()], "signal_key string, label string, category string")
    return dim.join(counted, "signal_key", "left").select(
        "signal_key", "label", "category", F.coalesce("detected_count", F.lit(0)).alias("detected_count"),
        F.coalesce("cases", F.lit(0)).alias("cases"),
        percent(F.coalesce("cases", F.lit(0)), total).alias("rate_percent"), "avg_score")


def stage_latency(stages: DataFrame) -> DataFrame:
    """Mean (cut to whole milliseconds), least and most per stage; stages never run have no row."""
    return stages.filter(F.col("duration_ms") > 0).groupBy("stage_key").agg(
        F.floor(F.avg("duration_ms")).alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms")) \
        .withColumn("stage_label", label_of("stage_key", policy.STAGE_LABELS))


def stage_rollup(stages: DataFrame) -> DataFrame:
    """Stages (case_id, order_index, stage_key, outcome): state of each case.

    ``outcome`` is done, warning, unavailable or error. A case fails on any
    error; once text recognition is unavailable, later stages that need it are too.
    """
    blocked = F.col("stage_key").isin(*policy.OCR_BOUND_STAGES)
    from_here = stages.groupBy("case_id").agg(
        F.min(F.when(F.col("outcome") == "unavailable", F.col("order_index"))).alias("dead_from"))
    seen = stages.join(from_here, "case_id").withColumn("effective", F.when(
        blocked & (F.col("order_index") > F.col("dead_from")), "unavailable").otherwise(F.col("outcome")))
    counted = seen.groupBy("case_id").agg(
        *[F.count_if(F.col("effective") == s).alias(s) for s in ("done", "warning", "unavailable", "error")])
    return counted.withColumn("status", F.when(F.col("error") > 0, "failed").otherwise("completed"))


def insights(key_figures: DataFrame, ranking: DataFrame, signals: DataFrame) -> DataFrame:
    """Findings in words from the small result tables above."""
    first = ranking.agg(F.min_by(F.struct("label", "count", "percentage"),
                                 F.struct(-F.col("count"), F.col("field_name")))).scalar()
    faces = signals.filter(F.col("signal_key") == "facial_photo_mismatch").agg(F.max("rate_percent")).scalar()
    key_figures = key_figures.withColumns({"_top": first, "_face": faces})
    top, face = F.col("_top"), F.col("_face")
    seconds = F.bround(F.col("avg_processing_time_ms") / 1000, 2)

    def row(when: Column, ident: Column, kind: Column, metric: Column, importance: Column) -> Column:
        return F.when(when, F.struct(ident.alias("id"), kind.alias("type"), metric.alias("metric"),
                                     importance.alias("importance")))

    good = F.col("pass_rate") >= 80
    rows = [
        row(F.lit(True), F.when(good, "quality_high").otherwise("review_alert"),
            F.when(good, "quality").otherwise("risk_alert"),
            F.when(good, F.concat(F.col("pass_rate").cast("string"), F.lit("% Pass Rate")))
            .otherwise(F.concat(F.col("high_risk_count").cast("string"), F.lit(" High-Risk Cases"))),
            F.when(good, "info").otherwise("high")),
        row(top["label"].isNotNull(), F.lit("top_mismatch"), F.lit("trend"),
            F.concat(top["label"], F.lit(": "), top["count"].cast("string"), F.lit(" occurrences")), F.lit("medium")),
        row(face > 0, F.lit("biometric_integrity"), F.when(face > 5, "risk_alert").otherwise("quality"),
            F.concat(face.cast("string"), F.lit("% mismatch rate")), F.when(face > 5, "high").otherwise("info")),
        row(F.lit(True), F.lit("latency_perf"), F.lit("performance"),
            F.concat(seconds.cast("string"), F.lit("s / case")), F.lit("info"))]
    return explode_present(key_figures, [], rows)


def number_cases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Running numbers for new cases after the highest one, without one task ranking the batch.

    Rows are numbered inside their own partition of a range sort; the offsets of
    the partitions, one small row each, are added afterwards.
    """
    highest = existing.agg(F.coalesce(F.max("case_number"), F.lit(policy.FIRST_CASE_NUMBER - 1))).scalar()
    placed = cut(incoming.repartitionByRange("created_at", "case_id").sortWithinPartitions("created_at", "case_id")
                 .withColumn("_slot", F.spark_partition_id())
                 .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_slot").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_slot").select(
        *incoming.columns, (F.col("_seq") + F.col("_off") + 1 + highest).alias("case_number"))

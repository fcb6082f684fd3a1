"""Who may see, edit and decide what; requests are judged set-at-a-time.

Roles that see every case are kept as one ``all`` grant per user: writing out
their user-by-case product would be the largest table of the system.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier import policy


def grants(cases: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, scope, case_id): ``all`` rows for overseeing roles, one ``case`` row per lead or member case."""
    overseers = users.filter(F.col("role").isin(*policy.SEES_ALL)).select(
        "user_id", F.lit("all").alias("scope"), F.lit(None).cast("bigint").alias("case_id"))
    ties = cases.select(F.col("lead_user_id").alias("user_id"), "case_id").unionByName(
        members.select("user_id", "case_id")).distinct()
    scoped = users.filter(~F.col("role").isin(*policy.SEES_ALL)).select("user_id")
    own = ties.join(scoped, "user_id", "left_semi").select("user_id", F.lit("case").alias("scope"), "case_id")
    return overseers.unionByName(own)


def visible_to(cases: DataFrame, members: DataFrame, user_id: int, role: str) -> DataFrame:
    """The cases one user sees."""
    if role in policy.SEES_ALL:
        return cases
    own = members.filter(F.col("user_id") == user_id).select("case_id")
    led = cases.filter(F.col("lead_user_id") == user_id).select("case_id")
    return semi(cases, own.unionByName(led), "case_id")


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def _judged(cases: DataFrame, members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (case_id, user_id, …) with role, lead, membership and the two rights."""
    joined = (
        requests.join(users.select("user_id", "role", "active"), "user_id", "left")
        .join(cases.select("case_id", "lead_user_id", "status", "legal_hold"), "case_id", "left")
        .join(members.select("case_id", "user_id", "access"), ["case_id", "user_id"], "left"))
    lead = F.coalesce(F.col("lead_user_id") == F.col("user_id"), F.lit(False))
    role = F.coalesce(F.col("role"), F.lit(""))
    sees = F.col("lead_user_id").isNotNull() & (
        role.isin(*policy.SEES_ALL) | lead | F.col("access").isNotNull())
    edits = (role != "auditor") & (
        (role == "admin") | lead | F.coalesce(F.col("access") == "editor", F.lit(False)))
    return joined.withColumn("is_lead", lead).withColumn("sees", sees).withColumn("edits", sees & edits) \
        .withColumn("commands", (role == "admin") | lead)


def _write_gate() -> Column:
    return (F.when(~F.col("sees"), "404").when(~F.col("edits"), "403")
            .when(F.col("status") == "archived", "409"))


def edit_rights(cases: DataFrame, members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict of a write by each (user, case): 404 unseen, 403 no right, 409 archived, ok."""
    archived = F.col("status") == "archived"
    return _judged(cases, members, users, requests).select(
        "case_id", "user_id", "sees",
        (F.col("edits") & ~archived).alias("can_edit"),
        (F.col("sees") & F.col("commands") & archived).alias("can_reopen"),
        F.coalesce(_write_gate(), F.lit("ok")).alias("verdict"))


def archival_gate(cases: DataFrame, members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Change requests (case_id, user_id, new_status, new_hold, other_change); nulls are fields left alone."""
    only_reopen = ((F.col("new_status") == "active") & F.col("new_hold").isNull() & ~F.col("other_change"))
    hold = F.coalesce(F.col("new_hold"), F.col("legal_hold"))
    verdict = (
        F.when(~F.col("sees"), "404").when(~F.col("edits"), "403")
        .when((F.col("status") == "archived") & ~(F.coalesce(only_reopen, F.lit(False)) & F.col("commands")), "409")
        .when(F.col("new_hold").isNotNull() & ~F.col("commands"), "403")
        .when((F.col("new_status") == "archived") & hold, "409").otherwise("ok"))
    return _judged(cases, members, users, requests).select(
        *requests.columns, verdict.alias("verdict"))


def member_gate(cases: DataFrame, members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (case_id, user_id, target_id, action add|remove, new_access)."""
    target = users.select(F.col("user_id").alias("target_id"), F.col("role").alias("target_role"),
                          F.col("active").alias("target_active"))
    held = members.select("case_id", F.col("user_id").alias("target_id"), F.lit(True).alias("held"))
    judged = _judged(cases, members, users, requests).join(target, "target_id", "left") \
        .join(held, ["case_id", "target_id"], "left")
    adding = F.col("action") == "add"
    verdict = (
        F.when(_write_gate().isNotNull(), _write_gate())
        .when(~F.col("commands"), "403")
        .when(adding & ~F.coalesce(F.col("target_active"), F.lit(False)), "404")
        .when(adding & (F.col("target_role") == "auditor") & (F.col("new_access") == "editor"), "422")
        .when(~adding & (F.col("target_id") == F.col("lead_user_id")), "409")
        .when(~adding & F.col("held").isNull(), "404").otherwise("ok"))
    return judged.select(*requests.columns, verdict.alias("verdict"))


def review_request_gate(cases: DataFrame, members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (case_id, user_id, assigned_to): the reviewer must be active and see the case."""
    reviewer = requests.select("case_id", F.col("assigned_to").alias("user_id")).distinct()
    able = _judged(cases, members, users, reviewer).select(
        "case_id", F.col("user_id").alias("assigned_to"),
        (F.col("sees") & F.coalesce(F.col("active"), F.lit(False))).alias("able"))
    judged = _judged(cases, members, users, requests).join(able, ["case_id", "assigned_to"], "left")
    verdict = F.when(_write_gate().isNotNull(), _write_gate()) \
        .when(~F.coalesce(F.col("able"), F.lit(False)), "422").otherwise("ok")
    return judged.select(*requests.columns, verdict.alias("verdict"))


def review_decision_gate(cases: DataFrame, members: DataFrame, users: DataFrame, reviews: DataFrame,
                         decisions: DataFrame) -> DataFrame:
    """Decisions (review_id, user_id, decision) on reviews, with the case state that follows."""
    known = reviews.select("review_id", "case_id", "assigned_to", F.col("status").alias("review_status"))
    asked = decisions.join(known, "review_id", "left")
    verdict = (
        F.when(F.col("assigned_to").isNull() | ~F.col("sees"), "404")
        .when(F.col("status") == "archived", "409")
        .when((F.col("assigned_to") != F.col("user_id")) & (F.col("role") != "admin"), "403")
        .when(F.col("review_status") != "pending", "409").otherwise("ok"))
    after = F.when(F.col("decision") == "approved", "closed").otherwise("active")
    judged = _judged(cases, members, users, asked).withColumn("verdict", verdict)
    return judged.select(*decisions.columns, "case_id", "verdict",
                         F.when(F.col("verdict") == "ok", after).alias("case_status"))


def apply_reviews(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """Cases after the accepted decisions; where several land on one case the last review wins."""
    changes = decided.filter(F.col("verdict") == "ok").groupBy("case_id").agg(
        F.max_by("case_status", "review_id").alias("new_status"))
    return cases.join(changes, "case_id", "left").withColumn(
        "status", F.coalesce("new_status", "status")).drop("new_status")


def review_queue(reviews: DataFrame, users: DataFrame, due_by: Column) -> DataFrame:
    """Pending work per reviewer, with how much of it is due."""
    waiting = reviews.filter(F.col("status") == "pending").groupBy("assigned_to").agg(
        F.count("*").alias("pending"), F.count_if(F.col("due_on") <= due_by).alias("due"),
        F.min("due_on").cast("string").alias("first_due"))
    return with_name(waiting, users, "assigned_to", "Unknown").withColumnRenamed("name", "assigned_name")


def with_name(df: DataFrame, users: DataFrame, id_col: str, default: str) -> DataFrame:
    names = users.select(F.col("user_id").alias(id_col), "name")
    return df.join(names, id_col, "left").withColumn("name", F.coalesce("name", F.lit(default)))


def retention_due(cases: DataFrame, as_of: Column) -> DataFrame:
    return cases.filter((F.col("retention_until") <= as_of) & ~F.col("legal_hold")
                        & (F.col("status") != "archived"))

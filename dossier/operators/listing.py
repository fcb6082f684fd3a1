"""Searches, filters, labels, cards and ordered picks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossier import policy
from dossier.functions.text import title_code


def ilike_term(col: Column | str, term: str, literal: bool = False) -> Column:
    """Case-blind substring; ``%`` and ``_`` act as wildcards unless ``literal``."""
    col = F.col(col) if isinstance(col, str) else col
    term = term.strip()
    if literal:
        return F.contains(F.lower(col), F.lit(term.lower()))
    return col.ilike(f"%{term}%")


def case_search(cases: DataFrame, term: str = "", status: str = "all", literal: bool = False) -> DataFrame:
    if term.strip():
        hit = [F.coalesce(ilike_term(c, term, literal), F.lit(False)) for c in ("reference", "title", "description")]
        cases = cases.filter(hit[0] | hit[1] | hit[2])
    return cases if status == "all" else cases.filter(F.col("status") == status)


def by_kind(docs: DataFrame, kind: str = "all", col: str = "kind") -> DataFrame:
    return docs if kind == "all" else docs.filter(F.col(col) == kind)


def audit_filter(events: DataFrame, visible: DataFrame | None = None, case_id: object = None) -> DataFrame:
    if case_id is not None:
        return events.filter(F.col("case_id") == case_id)
    return events if visible is None else events.join(visible.select("case_id"), "case_id", "left_semi")


def audit_text(events: DataFrame, term: str) -> DataFrame:
    """Events (action, actor_name, case_id) holding the term."""
    text = F.lower(F.concat_ws(" ", "action", "actor_name", F.coalesce(F.col("case_id").cast("string"), F.lit(""))))
    return events.filter(F.contains(text, F.lit(term.lower())))


def in_range(df: DataFrame, col: str, time_range: str, as_of: Column) -> DataFrame:
    """The last 7, 30 or 90 days; ``all`` keeps everything."""
    if time_range == "all":
        return df
    return df.filter(F.col(col) >= F.date_sub(as_of, policy.RANGE_DAYS.get(time_range, 30)))


def history_search(cases: DataFrame, people: DataFrame, term: str) -> DataFrame:
    """Cases (case_id, title, recommendation) by name, outcome, person or ``#number``."""
    term = term.strip().lower()
    def holds(name: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(term))

    number = F.concat(F.lit("#"), F.col("case_id").cast("string")) == term
    return cases.join(people, "case_id", "left").filter(
        holds("title") | holds("recommendation") | holds("person") | number)


def outcome_filter(cases: DataFrame, outcome: str) -> DataFrame:
    kept = policy.OUTCOME_FILTERS.get(outcome)
    return cases.filter(F.col("recommendation").isin(*kept)) if kept else cases


def severe(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity").isin("medium", "high"))


def label_of(col: Column | str, labels: Mapping[str, str]) -> Column:
    """The label of a code, else the code itself in title case."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), title_code(col))


def document_label(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    known = label_of(F.lower(F.trim(col)), policy.DOCUMENT_LABELS)
    return F.when(F.coalesce(col, F.lit("")) == "", policy.DOCUMENT_LABELS["unknown"]).otherwise(known)


def top_n(df: DataFrame, order: Sequence[Column], n: int, low: int = 1, high: int = 200) -> DataFrame:
    """The first rows in order, the number clamped; runs as a take-ordered, not a full sort."""
    return df.orderBy(*order).limit(max(low, min(n, high)))


def top_n_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    The rank filter is pushed below the shuffle, so a hot group sends at most
    ``n`` rows per input partition.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def history_page(cases: DataFrame, sort: str = "recent", limit: int = 200) -> DataFrame:
    risk = F.col("overall_risk")
    order = {
        "risk_desc": [F.coalesce(risk, F.lit(-1)).desc(), F.col("case_id").desc()],
        "risk_asc": [F.coalesce(risk, F.lit(999)).asc(), F.col("case_id").desc()],
    }.get(sort, [F.col("case_id").desc()])
    return top_n(cases, order, limit, 1, 500)


def latest(df: DataFrame, keys: Sequence[str], order: Column, *columns: str) -> DataFrame:
    """The row with the highest order value per key, by partial aggregation."""
    picked = F.max_by(F.struct(*columns), order).alias("latest")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"latest.{c}").alias(c) for c in columns])


def first_value_of(df: DataFrame, keys: Sequence[str], col: str, order: Column) -> DataFrame:
    """The first non-empty value per key in the given order."""
    return df.filter(F.coalesce(F.col(col).cast("string"), F.lit("")) != "").groupBy(*keys).agg(
        F.min_by(col, order).alias(col))


def best_candidate(df: DataFrame, keys: Sequence[str], score: str, order: Column, *columns: str) -> DataFrame:
    """The highest score per key; of equals the first."""
    picked = F.min_by(F.struct(score, *columns), F.struct((-F.col(score)), order)).alias("best")
    return df.groupBy(*keys).agg(picked).select(*keys, "best.*")


def share(df: DataFrame, col: str, name: str = "percentage") -> DataFrame:
    """Share of the total in percent. ``df`` is a small grouped result; the total is a scalar subquery."""
    total = df.agg(F.greatest(F.lit(1), F.sum(col))).scalar()
    return df.withColumn(name, F.bround(F.col(col) / total * 100, 1))


def mismatch_first(rows: DataFrame) -> DataFrame:
    """Comparison rows with their ``position`` in the case: conflicts first, then by name; a case has a row per field."""
    order = Window.partitionBy("case_id").orderBy(F.col("status") != "mismatch", "field_name")
    return rows.withColumn("position", F.row_number().over(order))


def case_card(cases: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per case with counts, plus its newest version; the versions themselves stay rows.

    ``version_history`` gives them newest first per document, so that no case has
    to fit into one nested value.
    """
    counts = docs.groupBy("case_id").agg(F.count("*").alias("document_count"))
    held = versions.groupBy("case_id").agg(
        F.count("*").alias("version_count"),
        F.max_by("filename", F.struct("created_on", "version_id")).alias("newest_filename"))
    return cases.join(counts, "case_id", "left").join(held, "case_id", "left").select(
        "case_id", "reference", "status",
        F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("version_count", F.lit(0)).alias("version_count"), "newest_filename",
        (F.col("status") == "archived").alias("read_only"))


def version_history(versions: DataFrame) -> DataFrame:
    """All versions of each document, ranked from the newest."""
    newest = Window.partitionBy("document_id").orderBy(F.col("number").desc())
    return versions.withColumn("rank", F.row_number().over(newest))


def joined_text(df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str], sep: str,
                part_rows: int = 1000) -> DataFrame:
    """Ordered concatenation per key in parts of ``part_rows`` values; parts follow one another by ``part_no``.

    ``order`` starts with an integer position; the columns after it decide ties.
    """
    placed = ordinals(df, keys, order[0], name="_place", ties=order[1:])
    return placed.withColumn("part_no", F.floor((F.col("_place") - 1) / part_rows).cast("int")).groupBy(
        *keys, "part_no").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_place", F.col(col).alias("_v")))),
            lambda s: s["_v"].cast("string")), sep).alias("text"))


def ordinals(df: DataFrame, keys: Sequence[str], position: str, width: int = 1000, name: str = "ordinal",
             ties: Sequence[str] = ()) -> DataFrame:
    """1, 2, 3 … per key by an integer position, without ranking a whole key in one task.

    Rows are ranked inside stretches of ``width`` positions; the counts of the
    stretches before, a small table, are added.
    """
    keys = list(keys)
    placed = df.withColumn("_stretch", F.floor(F.col(position) / width))
    ranked = placed.withColumn("_seq", F.row_number().over(
        Window.partitionBy(*keys, "_stretch").orderBy(position, *ties)))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n")).select(
        *keys, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return ranked.join(offsets, [*keys, "_stretch"]).withColumn(
        name, F.col("_seq") + F.col("_off")).drop("_stretch", "_seq", "_off")

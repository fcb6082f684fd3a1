"""Exports and append-only writes."""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

AUDIT_COLUMNS = {
    "id": "Event ID", "created_at": "Timestamp", "actor_name": "Actor", "action": "Action", "case_id": "Case ID",
    "target_id": "Target ID", "event_hash": "Event hash",
}


def audit_rows(events: DataFrame) -> DataFrame:
    """The seven exported columns as text, missing ids empty."""
    return events.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(title)
                           for c, title in AUDIT_COLUMNS.items()])


def quoted_line(df: DataFrame) -> DataFrame:
    """One CSV line per row: every value quoted, quotes doubled."""
    def quoted(name: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.col(f"`{name}`"), F.lit('"'), F.lit('""')), F.lit('"'))

    return df.select(F.concat_ws(",", *[quoted(c) for c in df.columns]).alias("line"))


def export_audit_csv(events: DataFrame, path: str) -> None:
    """A CSV dataset with a header, all values quoted and CRLF line ends."""
    audit_rows(events).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "lineSep", "\r\n").csv(path)


# Titles of the exported key figures and of the columns of the other sections, and what follows a figure.
KPI_TITLES = {
    "total_cases": ("Total Cases Screened", ""), "valid_count": ("Verification Passed", ""), "review_count": ("Under Review", ""),
    "high_risk_count": ("High Risk / Fraud Detected", ""), "pass_rate": ("Pass Rate (%)", "%"),
    "average_risk_score": ("Average Risk Index (0-100)", ""), "avg_processing_time_ms": ("Average Processing Duration", " ms"),
    "total_documents": ("Total Documents Inspected", ""), "face_checks": ("Facial Biometric Checks", ""),
}
SECTION_TITLES = {
    "trend": {"slot": ("DATE", ""), "valid": ("VALID", ""), "under_review": ("UNDER_REVIEW", ""), "high_risk": ("HIGH_RISK", ""),
              "total": ("TOTAL_SCREENED", "")},
    "ranking": {"label": ("DISCREPANCY FIELD", ""), "count": ("OCCURRENCE COUNT", ""),
                "percentage": ("PERCENTAGE OF TOTAL CONFLICTS", "%")},
    "types": {"label": ("DOCUMENT TYPE", ""), "count": ("COUNT", ""), "percentage": ("SHARE (%)", "%"), "pass_rate": ("PASS RATE (%)", "%"),
              "avg_confidence": ("OCR CONFIDENCE", "")},
}


def analytics_sections(kpis: DataFrame, trend: DataFrame, ranking: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """The four exported sections as text: one row per key figure, the others with their titled columns."""
    def text(column: str, unit: str) -> Column:
        value = F.format_string("%.2f", column) if column == "avg_confidence" else F.col(column).cast("string")
        return F.when(F.col(column).isNull(), "").otherwise(F.concat(value, F.lit(unit)))

    figures = kpis.select(F.explode(F.array(*[
        F.struct(F.lit(title).alias("METRIC"), text(c, unit).alias("VALUE")) for c, (title, unit) in KPI_TITLES.items()])).alias("figure"))
    given = {"trend": trend, "ranking": ranking, "types": types}
    return {"kpis": figures.select("figure.*")} | {
        name: df.select(*[text(c, unit).alias(title) for c, (title, unit) in SECTION_TITLES[name].items()]) for name, df in given.items()}


def export_analytics(sections: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV dataset per section (key figures, trends, discrepancy ranking, document types)."""
    for name, df in sections.items():
        df.write.option("header", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{name}")


def exported_lines(spark: SparkSession, sections: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """The lines of exported sections, all values quoted: of each section its titles (``is_row`` false) and its rows."""
    def lines(name: str, own: DataFrame) -> DataFrame:
        back = spark.read.schema(own.schema).option("header", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{name}").na.fill("")
        titles = spark.range(1).select(*[F.lit(c).alias(c) for c in back.columns])
        return quoted_line(titles).withColumn("is_row", F.lit(False)).unionByName(quoted_line(back).withColumn("is_row", F.lit(True))).select(
            F.lit(name).alias("section"), "is_row", "line")

    return reduce(DataFrame.unionByName, [lines(name, own) for name, own in sections.items()])


def next_versions(existing: DataFrame, incoming: DataFrame, width: int = 1000) -> DataFrame:
    """Incoming versions with the numbers that follow those of their document.

    ``incoming`` carries ``arrival``, a running number of the batch. Ranks are
    taken inside stretches of arrivals and offset by the stretches before, so a
    document with a third of the batch is no single task.
    """
    placed = incoming.withColumn("_stretch", F.floor(F.col("arrival") / width))
    inside = Window.partitionBy("document_id", "_stretch").orderBy("arrival")
    before = Window.partitionBy("document_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("document_id", "_stretch").agg(F.count("*").alias("_n")).select(
        "document_id", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    last = existing.groupBy("document_id").agg(F.max("number").alias("_last"))
    return placed.withColumn("_seq", F.row_number().over(inside)).join(
        offsets, ["document_id", "_stretch"]).join(last, "document_id", "left").select(
        *incoming.columns, (F.col("_seq") + F.col("_off") + F.coalesce("_last", F.lit(0))).alias("number"))


def append_versions(existing: DataFrame, incoming: DataFrame, path: str) -> DataFrame:
    """Append and return the new rows; earlier versions are never rewritten."""
    fresh = next_versions(existing, incoming)
    fresh.write.mode("append").parquet(path)
    return fresh


def number_clashes(versions: DataFrame) -> DataFrame:
    """(document_id, number) pairs that occur more than once; empty on a sound table."""
    return versions.groupBy("document_id", "number").agg(F.count("*").alias("n")).filter(F.col("n") > 1)

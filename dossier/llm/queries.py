"""The operators as queries over the tables of a folder: name → (spark, folder) → DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossier.llm import (bpe_counts, chat_format, decontamination, fill_in_middle, filter_audit, html_wrappers, line_dedup, lm_scoring,
                         mixing, quality_rules, simhash, substring_dedup, url_trust)
from dossier.session import cut
from dossier.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name."""
    QUERIES[function.__name__] = function
    return function


@query
def op1_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    rows = url_trust.verdicts(read(spark, folder, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations and one made of control strings, digested as read back from the formatted text."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, explode(array(0L, 1L)) AS turn").select(
        "conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"))
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = chat_format.formatted(given.unionByName(extra))
    read_back = made.select("conv_id", "formatted", F.explode(F.array(F.struct(
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("pieces")).alias("loss")))).alias("r"))
    lines = F.transform("r.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back.select(
        "conv_id", F.size("r.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("r.loss").cast("long").alias("loss_chars"), F.sha2("r.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judged(quality_rules.ledger(read(spark, folder, "documents")))
    failed = F.col("fail_bits").bitwiseAND(quality_rules.BASE) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "kept", "fail_bits")


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontamination.scan(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    hit = decontamination.hit_words(F.col("spans"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.without_repeats(read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", substring_dedup.removed_words(F.col("spans")).alias("n_removed"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(read(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.scores(read(spark, folder, "documents"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines, chunks, removed lines, and a digest of the text that is left."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rows = line_dedup.without_repeats(docs)
    return rows.select("doc_id", F.col("_before.lines").cast("long").alias("n_lines"),
                       F.col("_before.chunks").cast("long").alias("n_chunks"),
                       (F.col("_before.lines") - F.col("_after.lines")).cast("long").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op3_html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    rows = html_wrappers.extracted(read(spark, folder, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """The texts as a written store of frames; digests of the output and of what is read back from it."""
    store = cut(fill_in_middle.stored(read(spark, folder, "documents")))
    return fill_in_middle.digested(fill_in_middle.filled(store))


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op13_bpe_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_counts.counted(read(spark, folder, "documents"))

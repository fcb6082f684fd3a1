"""Keyed full-text index over evidence versions, and searches over it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossier.functions.crypto import word_hash
from dossier.functions.text import search_words
from dossier.operators.listing import ilike_term, top_n
from dossier.session import cut


def build_index(versions: DataFrame, key: bytes, existing: DataFrame | None = None,
                most: int | None = None) -> DataFrame:
    """(version_id, token_hash), one row per distinct word of each whole text.

    With ``existing``, only versions not indexed yet. ``most`` keeps the first
    words in lexical order and is off by default.
    """
    if existing is not None:
        versions = versions.join(existing.select("version_id").distinct(), "version_id", "left_anti")
    words = versions.select("version_id", F.explode(search_words("text", most)).alias("word"))
    return words.select("version_id", word_hash(F.col("word"), key).alias("token_hash"))


def write_index(index: DataFrame, table: str, buckets: int = 1024) -> None:
    """Bucketed by token, so that searches join without moving the index."""
    index.write.bucketBy(buckets, "token_hash").sortBy("token_hash", "version_id").mode("append").saveAsTable(table)


def query_words(queries: DataFrame, key: bytes) -> DataFrame:
    """(query_id, token_hash) of the distinct words of each query text."""
    words = queries.select("query_id", F.explode(search_words("text")).alias("word"))
    return words.select("query_id", word_hash(F.col("word"), key).alias("token_hash"))


def all_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, version_id) where the version holds every word of the query.

    Each query starts from its rarest word, so a word that occurs in a third of
    all texts never multiplies with the queries that use it; the other words
    are then looked up by (version, word). A query without words matches nothing.
    """
    # the words asked for, numbered: only their rows of the index move, with a number in place of the long hash
    asked = cut(terms.select("token_hash").distinct().withColumn("_no", F.monotonically_increasing_id()))
    index = index.join(asked, "token_hash").select("version_id", F.col("_no").alias("token_hash"))
    terms = terms.join(asked, "token_hash").select("query_id", F.col("_no").alias("token_hash"))
    frequency = index.groupBy("token_hash").agg(F.count("*").alias("df"))
    weighed = terms.join(frequency, "token_hash", "left")
    plans = weighed.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count("df").alias("known"),
        F.min_by("token_hash", F.struct("df", "token_hash")).alias("rarest")).filter(F.col("n") == F.col("known"))
    # queries with the same rarest word read its postings together
    starts = plans.select("query_id", "n", F.col("rarest").alias("token_hash"))
    found = starts.join(index, "token_hash").select("query_id", "n", "version_id", F.col("token_hash").alias("rarest"))
    rest = terms.join(plans.select("query_id", "rarest"), "query_id").filter(F.col("token_hash") != F.col("rarest")) \
        .select("query_id", "token_hash")
    single = found.filter(F.col("n") == 1).select("query_id", "version_id")
    checks = found.filter(F.col("n") > 1).join(rest, "query_id").select("query_id", "n", "version_id", "token_hash")
    held = checks.join(index, ["version_id", "token_hash"], "left_semi")
    several = held.groupBy("query_id", "version_id", "n").agg(F.count("*").alias("m")).filter(
        F.col("m") == F.col("n") - 1).select("query_id", "version_id")
    return single.unionByName(several)


def search_documents(docs: DataFrame, versions: DataFrame, index: DataFrame, query: str, key: bytes,
                     visible: DataFrame | None = None, kind: str = "all", limit: int = 100,
                     literal: bool = False) -> DataFrame:
    """Newest visible documents by title, by file name of any version, or by all words in one version."""
    if visible is not None:
        docs = docs.join(visible.select("case_id"), "case_id", "left_semi")
    if kind != "all":
        docs = docs.filter(F.col("kind") == kind)
    if query.strip():
        asked = docs.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
        texts = versions.join(all_terms(index, query_words(asked, key)), "version_id", "left_semi")
        named = versions.filter(ilike_term("filename", query, literal))
        titled = docs.filter(ilike_term("title", query, literal))
        ids = titled.select("document_id").unionByName(named.select("document_id")).unionByName(
            texts.select("document_id"))
        docs = docs.join(ids, "document_id", "left_semi")
    return top_n(docs, [F.col("created_on").desc(), F.col("document_id").desc()], limit)

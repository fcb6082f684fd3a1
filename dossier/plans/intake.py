"""Bulk intake of evidence files: gate, fingerprint, text, version numbers, index rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossier.functions.crypto import encrypt_text
from dossier.operators.search import build_index
from dossier.session import cut
from dossier.sources.files import extract_text, intake_check, with_sha256
from dossier.sources.sinks import next_versions

TEXT_AAD = "extracted-text"


def intake(files: DataFrame, existing: DataFrame, key: bytes) -> dict[str, DataFrame]:
    """Tables to append: refused files, new versions with sealed text, and their index rows.

    ``files``: path, content, document_id, arrival. ``existing``: document_id, number.
    """
    judged = intake_check(files, containers=False)  # a broken container is kept as evidence, its text unavailable
    refused = judged.filter(~F.col("accepted")).select("path", "document_id", "reason")
    good = with_sha256(judged.filter("accepted"))
    texts = extract_text(good.select("path", "content"))
    numbered = next_versions(existing, good.select("path", "document_id", "arrival", "filename", "mime",
                                                   "byte_size", "sha256"))
    versions = cut(numbered.join(texts, "path").withColumn(
        "version_id", F.sha2(F.concat_ws("/", "document_id", F.col("number").cast("string")), 256)))
    index = build_index(versions.select("version_id", "text"), key)
    sealed = versions.withColumn("encrypted_text", encrypt_text("text", key, TEXT_AAD)).drop("text")
    return {"refused": refused, "versions": sealed, "index": index}

"""Evidence files: intake gates, text, fingerprints, sealed blobs."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossier import policy
from dossier.functions.text import base_name, extension, present, safe_file_name
from dossier.operators.validation import lookup


DOCX_PART = "word/document.xml"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _container_fault(content: bytes, most: int) -> str | None:
    """What is wrong with a DOCX container: its directory is read, not its text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            size = archive.getinfo(DOCX_PART).file_size
    except zipfile.BadZipFile:
        return "DOCX container is not readable"
    except KeyError:
        return "DOCX container has no document part"
    return "DOCX text is too large" if size > most else None


def container_fault(content: Column, most: int = policy.MAX_DOCX_XML_BYTES) -> Column:
    """The fault of a DOCX file, null for a sound one and for null content."""
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else _container_fault(c, most)).astype(object)

    return F.pandas_udf(run, "string")(content)


def intake_check(files: DataFrame, most: int = policy.MAX_UPLOAD_BYTES, most_docx: int = policy.MAX_DOCX_XML_BYTES,
                 containers: bool = True) -> DataFrame:
    """Verdict per file (path, content): kind, size, leading bytes, encoding and, with ``containers``, DOCX container.

    The first failing rule gives the reason. Only the contents of DOCX files of a fair size leave the JVM.
    """
    named = files.withColumn("filename", F.substring(base_name("path"), 1, 240)).withColumn(
        "extension", extension("filename"))
    content, suffix = F.col("content"), F.col("extension")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    magic = lookup(suffix, policy.MAGIC_BY_EXTENSION)
    leads = F.hex(F.substring(content, 1, 8)).startswith(magic)
    reason = (
        F.when(~suffix.isin(*policy.MIME_BY_EXTENSION), "unsupported type")
        .when((size < 1) | (size > most), "size out of bounds")
        .when(magic.isNotNull() & ~leads, "content does not match extension")
        .when((suffix == ".txt") & ~F.is_valid_utf8(content.cast("string")), "text is not UTF-8"))
    packed = F.when((suffix == ".docx") & leads & (size <= most), content)
    if containers:
        reason = F.coalesce(reason, container_fault(packed, most_docx))
    return named.withColumn("mime", lookup(suffix, policy.MIME_BY_EXTENSION)).withColumn(
        "byte_size", size.cast("long")).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def screen_upload_check(df: DataFrame, most: int = policy.MAX_UPLOAD_BYTES) -> DataFrame:
    """Screening variant over (path, declared_mime, byte_size): images and PDF with plausible types."""
    suffix = extension("path")
    allowed = lookup(suffix, {k: F.array(*[F.lit(m) for m in v]) for k, v in policy.SCREENING_MIMES.items()})
    declared = present("declared_mime")
    reason = (
        F.when(~suffix.isin(*policy.SCREENING_MIMES), "unsupported type")
        .when(declared.isNotNull() & ~F.array_contains(allowed, declared), "type does not match extension")
        .when(F.col("byte_size") <= 0, "empty").when(F.col("byte_size") > most, "too large"))
    return df.withColumn("safe_name", safe_file_name("path")).withColumn("reason", reason).withColumn(
        "accepted", F.col("reason").isNull())


def with_sha256(df: DataFrame, col: str = "content", name: str = "sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(col), 256))


def html_text(col: Column | str) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, basic entities decoded."""
    text = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _docx(content: bytes) -> tuple[str | None, str]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            parts = []
            with archive.open(DOCX_PART) as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag.endswith("}t"):
                        parts.append(node.text or "")
                    elif node.tag.endswith("}p"):
                        node.clear()  # the texts of a paragraph are out, so its nodes may go
        text = " ".join(parts)
        return text, "extracted" if text.strip() else "no_text"
    except Exception:  # noqa: BLE001 - a broken file is a row, not a failed job
        return "", "unavailable"


def _docx_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [_docx(c) for c in batch["content"]]
        yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in read],
                            "extraction_status": [s for _, s in read]})


def extract_text(files: DataFrame) -> DataFrame:
    """Text and status per file (path, content): extracted, no_text or unavailable. Whole texts are kept, of any size."""
    suffix = extension("path")
    plain = files.filter(suffix.isin(".txt", ".html", ".htm"))
    raw = F.decode("content", "UTF-8")
    text = F.when(suffix == ".txt", raw).otherwise(html_text(raw))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    status = F.when(suffix == ".txt", "extracted").when(F.trim("text") == "", "no_text").otherwise("extracted")
    read = plain.filter(valid).select("path", text.alias("text")).withColumn("extraction_status", status)
    packed = files.filter(suffix == ".docx").select("path", "content").mapInPandas(
        _docx_batches, "path string, text string, extraction_status string")
    rest = files.filter(~suffix.isin(".txt", ".html", ".htm", ".docx")
                        | (suffix.isin(".txt", ".html", ".htm") & ~valid)).select(
        "path", F.lit("").alias("text"), F.lit("unavailable").alias("extraction_status"))
    return read.unionByName(packed).unionByName(rest)


def valid_storage_key(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.rlike(r"^[0-9a-f]{32}\.vault$")


def verify_blobs(versions: DataFrame, files: DataFrame, key: bytes) -> DataFrame:
    """Each version (version_id, storage_key, sha256) against its sealed file (path, content)."""
    stored = files.select(F.substring_index("path", "/", -1).alias("storage_key"), "content")
    opened = F.try_aes_decrypt("content", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"))
    joined = versions.join(stored, "storage_key", "left").withColumn("_plain", opened)
    reason = (
        F.when(~valid_storage_key("storage_key"), "invalid storage key")
        .when(F.col("content").isNull(), "file missing").when(F.col("_plain").isNull(), "integrity check failed")
        .when(F.sha2("_plain", 256) != F.col("sha256"), "hash differs from record"))
    return joined.select("version_id", "storage_key", reason.isNull().alias("verified"), reason.alias("reason"))


def seal(content: Column, key: bytes) -> Column:
    """Nonce, ciphertext and tag as stored in a blob."""
    return F.aes_encrypt(content, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"))

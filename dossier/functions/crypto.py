"""Keyed digests and column encryption from Spark's built-in functions."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from dossier.functions.text import _c

_BLOCK = 64
_PREFIX = "enc:v1:"


def _pads(key: bytes) -> tuple[Column, Column]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = bytearray(b ^ 0x36 for b in key)
    outer = bytearray(b ^ 0x5C for b in key)
    return F.lit(inner), F.lit(outer)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA-256 of a text column; runs in the JVM."""
    inner, outer = _pads(key)
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def word_hash(word: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat(F.lit("search:"), word), key)


def encrypt_text(col: Column | str, key: bytes, aad: str) -> Column:
    """Empty text stays empty; the nonce is random per row."""
    col = _c(col)
    sealed = F.aes_encrypt(F.encode(col, "UTF-8"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"),
                           F.unhex(F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 24)),
                           F.lit(aad))
    return F.when(col == "", col).when(col.isNotNull(), F.concat(F.lit(_PREFIX), F.base64(sealed)))


def decrypt_text(col: Column | str, key: bytes, aad: str) -> Column:
    """Null marks text that does not carry the prefix or fails authentication."""
    col = _c(col)
    body = F.try_to_binary(F.substring(col, len(_PREFIX) + 1, 2147483647), F.lit("base64"))
    opened = F.try_aes_decrypt(body, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))
    return F.when(col == "", col).when(col.startswith(_PREFIX), opened.cast("string"))

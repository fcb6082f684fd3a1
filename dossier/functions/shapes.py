"""Hashes, boxes, vectors and check digits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from dossier.functions.text import _c

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHECK_WEIGHTS = (7, 3, 5)


def check_digit(col: Column | str, weights: Sequence[int] = CHECK_WEIGHTS) -> Column:
    """Weighted sum of digits, letters (A=10) and fillers (0), modulo ten; null on other characters."""
    col = _c(col)
    cycle = F.array(*[F.lit(w) for w in weights])

    def worth(char: Column, position: Column) -> Column:
        value = F.greatest(F.instr(F.lit(_DIGITS), char) - 1, F.lit(0))
        return value * F.element_at(cycle, (position % len(weights) + 1).cast("int"))

    total = F.aggregate(F.transform(F.split(col, ""), worth), F.lit(0), lambda a, b: a + b)
    return F.when(col.rlike("^[0-9A-Z<]+$"), (total % 10).cast("string")).when(col == "", F.lit("0"))


def hash_bits(hex_text: Column | str) -> Column:
    """A 16-digit hex hash as a 64-bit number; null when it is not one."""
    col = _c(hex_text)
    high = F.conv(F.substring(col, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(col, 9, 8), 16, 10).cast("long")
    return F.when(col.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap of two x, y, w, h boxes over their union."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    wide = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    high = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    inter = wide * high
    return F.when(inter > 0, inter / (aw * ah + bw * bh - inter)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def fused_score(metrics: Sequence[Column], weights: Sequence[float]) -> Column:
    total = sum((m * w for m, w in zip(metrics, weights)), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total * 100, 0).cast("int")))


def severity_of(score: Column | str) -> Column:
    score = _c(score)
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")

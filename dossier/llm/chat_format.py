"""Chat formatting: one training text per conversation, with a loss mask, by Spark expressions only.

Template::

    <s><|start|>role<|text|>first turn<|more|>next turn of the same role<|end|><|start|>...<|end|></s>

Control strings inside texts and roles get one backslash more after their first character
(``</s>`` to ``<\\/s>``, ``<\\/s>`` to ``<\\\\/s>``); taking one away is the exact inverse.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import let

BOS, EOS, START, TEXT, MORE, END = "<s>", "</s>", "<|start|>", "<|text|>", "<|more|>", "<|end|>"
# what follows the first character of a control string, of this template and of common others
# (no tail may hold "<" or "[", or taking backslashes away would miss one)
_TAILS = r"(?:/?s>|\|[A-Za-z_]+\|>|/?INST\]|/?SYS>>)"
STRETCH = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={_TAILS})", "$1$2")


def _pieces(turns: Column, trained: Column) -> Column:
    """Sorted turns to template pieces; neighbours of one role share a block. Every piece says whether it is learned."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    none = F.lit(False)

    def block(t: Column, i: Column) -> Column:
        opens = F.coalesce(F.get(turns, i - 1)["role"] != t["role"], F.lit(True))
        closes = F.coalesce(F.get(turns, i + 1)["role"] != t["role"], F.lit(True))
        head = F.when(opens, F.concat(F.lit(START), t["role"], F.lit(TEXT))).otherwise(F.lit(MORE))
        return F.array(piece(head, none), piece(t["text"], F.array_contains(trained, t["role"])),
                       piece(F.when(closes, F.lit(END)).otherwise(F.lit("")), none))

    return F.concat(F.array(piece(F.lit(BOS), none)), F.flatten(F.transform(turns, block)),
                    F.array(piece(F.lit(EOS), none)))


def formatted(rows: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations as ``conv_id, pieces, formatted``.

    ``pieces`` holds text and loss flag in order; ``formatted`` is their concatenation. Turns stand by
    ``turn`` (nulls first), ties by role and text; repeated rows stay. Null roles and texts are empty; rows
    without an id form one conversation. Texts are escaped before the first shuffle, and long
    conversations meet in stretches of turns first; a conversation is one value of the output, so its
    stretches come together in the end. An empty table gives no rows.
    """
    safe = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
                       escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    parts = safe.groupBy("conv_id", stretch).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("stretch", "turns"))).alias("parts"))
    trained = F.array(*[escaped(F.lit(r)) for r in trained_roles])
    turns = F.flatten(F.transform("parts", lambda p: p["turns"]))
    pieces = let(turns, lambda t: _pieces(t, trained))
    return whole.select("conv_id", F.explode(F.array(pieces)).alias("pieces")).withColumn(
        "formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    inner = F.substring(text, len(BOS) + 1, F.length(text) - len(BOS) - len(EOS))
    blocks = F.filter(F.split(inner, r"<\|start\|>"), lambda b, i: i > 0)

    def of(block: Column) -> Column:
        halves = F.split(block, r"<\|text\|>", 2)
        texts = F.split(F.regexp_replace(F.get(halves, F.lit(1)), r"<\|end\|>\z", ""), r"<\|more\|>")
        return F.transform(texts, lambda t: F.struct(unescaped(F.get(halves, F.lit(0))).alias("role"),
                                                     unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")

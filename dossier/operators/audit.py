"""Keyed hash-linked audit logs: digests, links, appending and verification.

A log is kept as many chains (``chain``: a case, or a segment and a stretch of
ids). Events of one chain depend on each other, so only a bounded stretch may
share one; ``chain_name`` makes such names.
"""
from __future__ import annotations

import hmac
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dossier import policy
from dossier.functions.crypto import hmac_sha256

CHAIN_EVENTS = 10_000


def chain_name(segment: Column, number: Column, events: int = CHAIN_EVENTS) -> Column:
    """Chain of an event: its segment and the stretch of event numbers it falls in."""
    return F.concat_ws("/", segment.cast("string"), F.floor(number / events).cast("string"))


def iso_time(col: Column) -> Column:
    """ISO text without zone; microseconds appear only where there are any."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(col, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def _quoted(col: Column) -> Column:
    text = F.to_json(F.array(col.cast("string")))
    return F.coalesce(F.when(col.isNotNull(), F.substring(text, 2, F.length(text) - 2)), F.lit("null"))


def payload_around(event: Column | None = None) -> tuple[Column, Column]:
    """The digested text before and after the previous hash: keys in order, no spaces, nulls kept.

    ``details`` goes in as stored JSON text.
    """
    def of(name: str) -> Column:
        return F.col(name) if event is None else event[name]

    before = F.concat(
        F.lit('{"action":'), _quoted(of("action")), F.lit(',"actor":'), _quoted(of("actor_id")),
        F.lit(',"case":'), _quoted(of("case_id")), F.lit(',"details":'), F.coalesce(of("details"), F.lit("{}")),
        F.lit(',"previous":'))
    after = F.concat(F.lit(',"target":'), _quoted(of("target_id")), F.lit(',"time":'), _quoted(iso_time(of("created_at"))),
                     F.lit("}"))
    return before, after


def payload(previous: Column, event: Column | None = None) -> Column:
    """The whole digested text of an event."""
    before, after = payload_around(event)
    return F.concat(before, _quoted(previous), after)


def digest(previous: Column, key: bytes, event: Column | None = None) -> Column:
    return hmac_sha256(payload(previous, event), key)


def link_check(events: DataFrame, keys: Sequence[str] = ("chain",), stretch: int = 100_000) -> DataFrame:
    """Events with ``expected_previous``: the hash of the event before, or zeros for the first.

    The look-back runs inside stretches of ids; the last hash of each stretch,
    a small table, gives the first row of the next one its predecessor.
    """
    keys = list(keys)
    placed = events.withColumn("_stretch", F.floor(F.col("id") / stretch))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("id")
    near = placed.withColumn("_near", F.lag("event_hash").over(inside))
    tails = placed.groupBy(*keys, "_stretch").agg(F.max_by("event_hash", "id").alias("_tail"))
    along = Window.partitionBy(*keys).orderBy("_stretch")
    heads = tails.select(*keys, "_stretch", F.lag("_tail").over(along).alias("_far"))
    return near.join(heads, [*keys, "_stretch"]).withColumn(
        "expected_previous", F.coalesce("_near", "_far", F.lit(policy.GENESIS))).drop("_near", "_far", "_stretch")


def verify_audit(events: DataFrame, heads: DataFrame, key: bytes, stretch: int = 100_000) -> DataFrame:
    """Per chain: valid, number of events before the first broken one, and where it breaks.

    ``heads`` (chain, event_hash) are the recorded last hashes; a chain that is
    shorter than its head says breaks at ``head``.
    """
    linked = link_check(events, ["chain"], stretch)
    broken = (F.col("previous_hash") != F.col("expected_previous")) | \
        (F.col("event_hash") != digest(F.col("previous_hash"), key))
    flagged = linked.select("chain", "id", "event_hash", F.coalesce(broken, F.lit(True)).alias("bad"),
                            F.floor(F.col("id") / stretch).alias("_stretch"))
    seq = F.row_number().over(Window.partitionBy("chain", "_stretch").orderBy("id"))
    parts = flagged.withColumn("_seq", seq).groupBy("chain", "_stretch").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.struct("id", "_seq"))).alias("first_bad"),
        F.max(F.struct("id", "event_hash")).alias("last"))
    breaks = parts.filter(F.col("first_bad").isNotNull()).groupBy("chain").agg(
        F.min(F.struct("_stretch", "first_bad")).alias("b"))
    joined = parts.join(breaks, "chain", "left")
    before = F.when(F.col("b").isNull() | (F.col("_stretch") < F.col("b._stretch")), F.col("n")).when(
        F.col("_stretch") == F.col("b._stretch"), F.col("b.first_bad._seq") - 1).otherwise(0)
    chains = joined.groupBy("chain").agg(
        F.sum(before).cast("long").alias("checked"), F.first("b.first_bad.id").alias("bad_id"),
        F.max("last").alias("last"))
    known = heads.select("chain", F.col("event_hash").alias("head_hash"))
    compared = chains.join(known, "chain", "full")
    tail_ok = F.coalesce(F.col("last.event_hash"), F.lit(policy.GENESIS)) == F.col("head_hash")
    where = F.when(F.col("bad_id").isNotNull(), F.col("bad_id").cast("string")).when(
        ~F.coalesce(tail_ok, F.lit(False)), "head")
    return compared.select("chain", where.isNull().alias("valid"),
                           F.coalesce("checked", F.lit(0)).alias("checked"), where.alias("broken_at"))


_EVENT = ("id", "actor_id", "case_id", "action", "target_id", "details", "created_at")


def append_audit(events: DataFrame, heads: DataFrame, key: bytes) -> DataFrame:
    """Link new events (chain, id, actor_id, case_id, action, target_id, details, created_at) to their chains.

    The rows of a chain pass one task in the order of their ids, and only the last hash is carried from one to the
    next: linear in the events, and no chain is ever held. What depends on a row alone is put together before, in the
    JVM. ``heads`` (chain, event_hash) are the last hashes so far, those after it are ``chain_heads`` of the result.
    """
    before, after = payload_around()
    known = heads.select(F.col("chain").alias("_chain"), F.col("event_hash").alias("_head"))
    rows = events.select("chain", *_EVENT, before.alias("_before"), after.alias("_after")).join(
        known, F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain")
    result = StructType([*events.select("chain", *_EVENT).schema, StructField("previous_hash", StringType()),
                         StructField("event_hash", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = object(), policy.GENESIS
        for batch in batches:
            previous, own = [], []
            for name, head, front, back in zip(*(batch.column(c).to_pylist() for c in ("chain", "_head", "_before", "_after"))):
                if name != chain:
                    chain, last = name, head or policy.GENESIS
                previous.append(last)
                last = hmac.digest(key, f'{front}"{last}"{back}'.encode(), "sha256").hex()
                own.append(last)
            kept = [batch.column(n) for n in result.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(previous, pa.string()), pa.array(own, pa.string())], names=result.names)

    return rows.repartition("chain").sortWithinPartitions("chain", "id").mapInArrow(fold, result)


def chain_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("chain").agg(F.max_by("event_hash", "id").alias("event_hash"))

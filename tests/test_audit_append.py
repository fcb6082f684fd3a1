"""Appending to hash-linked logs: a loop over the events, in one go and in turn, and a chain that is never held."""
from __future__ import annotations

import hmac
import json

from pyspark.sql import functions as F

from dossier import policy
from dossier.operators import audit

KEY = b"0123456789abcdef0123456789abcdef"
EVENTS = "chain string, id long, actor_id long, case_id long, action string, target_id string, details string, created_at timestamp"


def events_of(spark, many):
    """A hot chain with a third of the rows, a chain without a name, and nulls."""
    n = F.col("id")
    return spark.range(many).select(
        F.when(n % 3 == 0, "hot").when(n % 1000 == 7, F.lit(None)).otherwise(F.concat(F.lit("c"), (n % 20).cast("string"))).alias("chain"),
        "id", (n % 9).alias("actor_id"), F.when(n % 5 != 0, n % 11).alias("case_id"), F.lit('say "x"').alias("action"),
        F.when(n % 4 == 0, F.lit("tÄ")).alias("target_id"), F.when(n % 6 != 0, F.lit('{"a":1}')).alias("details"),
        F.timestamp_micros(n * 1_000_500 + 1_700_000_000_000_000).alias("created_at"))


def looped(rows):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        previous = last.get(r["chain"], policy.GENESIS)
        stamp = r["created_at"].isoformat()
        text = lambda v: "null" if v is None else json.dumps(str(v), ensure_ascii=False)
        body = (f'{{"action":{text(r["action"])},"actor":{text(r["actor_id"])},"case":{text(r["case_id"])},"details":{r["details"] or "{}"},'
                f'"previous":"{previous}","target":{text(r["target_id"])},"time":"{stamp}"}}')
        last[r["chain"]] = hmac.new(KEY, body.encode(), "sha256").hexdigest()
        out[r["id"]] = (previous, last[r["chain"]])
    return out


def test_append_equals_a_loop_in_one_go_and_in_turn(spark):
    none = spark.createDataFrame([], "chain string, event_hash string")
    rows = events_of(spark, 3000).orderBy(F.hash("id"))
    whole = audit.append_audit(rows, none, KEY)
    assert whole.columns == ["chain", *audit._EVENT, "previous_hash", "event_hash"]
    want = looped(rows.collect())
    assert {r["id"]: (r["previous_hash"], r["event_hash"]) for r in whole.collect()} == want
    first = audit.append_audit(rows.filter("id < 1234"), none, KEY)
    second = audit.append_audit(rows.filter("id >= 1234"), audit.chain_heads(first), KEY)
    assert {r["id"]: (r["previous_hash"], r["event_hash"]) for r in first.unionByName(second).collect()} == want
    assert audit.append_audit(rows.limit(0), none, KEY).count() == 0


def test_a_long_chain_passes_in_batches(spark):
    none = spark.createDataFrame([], "chain string, event_hash string")
    rows = events_of(spark, 50_000).withColumn("chain", F.lit("one"))
    log = audit.append_audit(rows, none, KEY)
    assert log.select("previous_hash").distinct().count() == 50_000
    checked = audit.verify_audit(log, audit.chain_heads(log), KEY).collect()
    assert [(r["valid"], r["checked"]) for r in checked] == [(True, 50_000)]

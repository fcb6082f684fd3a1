"""The stateful streams give what a loop over the ordered rows gives, whatever batches the rows come in."""
from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from dossier import policy
from dossier.operators import audit
from dossier.streaming import jobs

START = dt.datetime(2024, 1, 1)
ATTEMPTS = "user_id long, event_id long, ts timestamp, success boolean"
EVENTS = "chain string, id long, actor_id long, case_id long, action string, target_id string, details string, created_at timestamp"
KEY = b"0123456789abcdef0123456789abcdef"


@pytest.fixture(params=[5, 10_000])
def arrow(spark, request):
    """The size of an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield request.param
    spark.conf.set(name, before)


def in_files(spark, rows, schema, folder, parts):
    """The rows dealt over files that the stream takes one in each micro-batch, in this order."""
    os.makedirs(folder)
    each = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * each:(k + 1) * each], schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            if name.endswith(".parquet"):
                os.utime(f"{folder}/{k}/{name}", (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(folder)


def looped(rows):
    failures, until, out = {}, {}, {}
    for user, event, ts, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        if user in until and until[user] > ts:
            out[event] = "rejected"
        elif ok:
            failures[user], out[event] = 0, "accepted"
            until.pop(user, None)
        else:
            failures[user] = failures.get(user, 0) + 1
            out[event] = "failed"
            if failures[user] == policy.LOCK_AFTER_FAILURES:
                failures[user], until[user], out[event] = 0, ts + dt.timedelta(minutes=policy.LOCK_MINUTES), "locked"
    return out


def test_attempts_shuffled_over_micro_batches(spark, tmp_path, arrow):
    rng = random.Random(1)
    # user 1 is hot; ties in time; rows come up to 50 minutes out of order, inside the watermark of an hour
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 5), k, START + dt.timedelta(minutes=k // 2), rng.random() < 0.12) for k in range(600)]
    mixed = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, 50)))
    stream = jobs.lockouts(in_files(spark, mixed, ATTEMPTS, f"{tmp_path}/in", 4))
    got = jobs.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/at").collect()
    settled = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = looped(rows)
    assert {(r["event_id"], r["outcome"]) for r in got} == {(r[1], want[r[1]]) for r in rows if r[2] < settled}
    assert len(got) == sum(1 for r in rows if r[2] < settled) and not any(r["late"] for r in got)
    assert {"locked", "rejected", "accepted", "failed"} == {r["outcome"] for r in got}


def test_rows_far_behind_are_shown_as_late(spark, tmp_path):
    rows = [(1, k, START + dt.timedelta(hours=k), False) for k in range(12)]
    late = [(1, 100, START + dt.timedelta(hours=1, minutes=5), True), (2, 101, START, False), (None, 102, START, False)]
    stream = jobs.lockouts(in_files(spark, rows[:11] + late + rows[11:], ATTEMPTS, f"{tmp_path}/in", 3))
    got = {r["event_id"]: r for r in jobs.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/at").collect()}
    assert got[100]["late"] and got[100]["outcome"] == "late"
    assert not got[101]["late"] and got[101]["outcome"] == "failed"  # nothing of user 2 had been judged
    assert got[102]["outcome"] == "failed" and got[2]["ts"] == START + dt.timedelta(hours=2)
    assert sorted(k for k, r in got.items() if not r["late"]) == [*range(10), 101, 102]


def test_damaged_log_shuffled_over_micro_batches(spark, tmp_path, arrow):
    rng = random.Random(2)
    events = [("hot" if k % 3 else "c%d" % (k % 5), k, k % 9, 1, "edit", None, '{"n":%d}' % k, START + dt.timedelta(minutes=k)) for k in range(300)]
    none = spark.createDataFrame([], "chain string, event_hash string")
    log = audit.append_audit(spark.createDataFrame(events, EVENTS), none, KEY)
    rows = [r.asDict() for r in log.collect()]
    rows = [r for r in rows if r["id"] % 41 != 7]  # lost events
    for r in rows:
        if r["id"] % 37 == 5:
            r["action"] = "changed"
        if r["id"] % 29 == 3:
            r["previous_hash"] = None
    last, want, settled = {}, {}, max(r["created_at"] for r in rows) - dt.timedelta(hours=1)
    for r in sorted(rows, key=lambda r: r["id"]):
        if r["created_at"] < settled:
            want[r["id"]] = (r["previous_hash"] == last.get(r["chain"], policy.GENESIS), r["id"] % 37 != 5 and r["id"] % 29 != 3)
        last[r["chain"]] = r["event_hash"]
    mixed = sorted(rows, key=lambda r: r["created_at"] + dt.timedelta(minutes=rng.uniform(0, 55)))
    schema = EVENTS + ", previous_hash string, event_hash string"
    names = [x.split()[0] for x in schema.split(", ")]
    source = in_files(spark, [tuple(r[n] for n in names) for r in mixed], schema, f"{tmp_path}/in", 3)
    got = jobs.run_available(jobs.live_links(source, KEY), f"{tmp_path}/out", f"{tmp_path}/at").collect()
    assert {r["id"]: (r["linked"], r["sound"]) for r in got} == want and len(got) == len(want)
    assert not any(r["late"] for r in got) and {(a, b) for a, b in want.values()} == {(True, True), (True, False), (False, True), (False, False)}


def test_waiting_rows_survive_a_restart(spark, tmp_path):
    rows = [(1, k, START + dt.timedelta(minutes=10 * k), False) for k in range(30)]
    folder = f"{tmp_path}/in"
    source = in_files(spark, rows[:15][::-1], ATTEMPTS, folder, 1)
    first = jobs.run_available(jobs.lockouts(source), f"{tmp_path}/out", f"{tmp_path}/at").count()
    spark.createDataFrame(rows[15:], ATTEMPTS).coalesce(1).write.parquet(f"{folder}/more")
    got = jobs.run_available(jobs.lockouts(source), f"{tmp_path}/out", f"{tmp_path}/at").collect()
    want = looped(rows)
    assert first == 8 and len(got) == 23
    assert {r["event_id"]: r["outcome"] for r in got} == {k: want[k] for k in range(23)}

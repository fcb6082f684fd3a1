"""What waits for the watermark is kept in few chunks, and overlapping ones are merged in order."""
import random

import pandas as pd

from dossier.streaming import ordered
from dossier.streaming.ordered import AT, NUMBER, ORDER, InOrder


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    written = 0

    def updateValue(self, key, value):  # noqa: N802
        self.written += 1
        self[key] = value

    def getValue(self, key):  # noqa: N802
        return self[key]

    def removeKey(self, key):  # noqa: N802
        del self[key]


class _Handle:
    def __init__(self):
        self.map, self.value, self.timers = _Map(), _Value(), set()

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


class _Seen(InOrder):
    fields = "seen long"

    def begin(self):
        return (0,)

    def apply(self, key, state, rows):
        return (state[0] + len(rows),), rows

    def late(self, key, rows):
        return rows.assign(late=True)


def frame(rows):
    return pd.DataFrame(rows, columns=[ORDER, NUMBER, AT])


def fire(job, handle, at):
    out = []
    for t in sorted(t for t in handle.timers if t <= at):
        handle.timers.discard(t)
        for part in job.handleExpiredTimer((1,), _Clock(at), None):
            out += part[[ORDER, NUMBER]].values.tolist()
    return out


def test_a_quiet_key_waits_in_one_chunk():
    job, handle = _Seen(), _Handle()
    job.init(handle)
    hour = 3_600_000_000
    assert not list(job.handleInputRows((1,), iter([frame([(k * hour, k, k * 3_600_000) for k in range(30)])]), None))
    assert len(handle.map) == handle.map.written == 1
    assert fire(job, handle, 10 * 3_600_000) == [[k * hour, k] for k in range(10)]
    assert len(handle.map) == 1 and handle.value.value[-1] == 10 and len(handle.timers) == 1


def test_overlapping_chunks_come_out_in_order(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)
    rng = random.Random(4)
    rows = [(k // 3, k, k // 3 * 10) for k in range(300)]  # ties in the order
    mixed = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 25))
    job, handle = _Seen(), _Handle()
    job.init(handle)
    got = []
    for at in range(0, 300, 50):
        batch = mixed[at:at + 50]
        assert not list(job.handleInputRows((1,), iter([frame(batch[:20]), frame(batch[20:])]), None))
        got += fire(job, handle, max(0, max(r[2] for r in mixed[:at + 50]) - 260))
    got += fire(job, handle, 10_000)
    assert got == [[o, n] for o, n, _ in rows] and not handle.map and not handle.timers

"""Rows of a key applied in their own order, however they arrive.

A stateful job that must see the rows of a key in order keeps them until the watermark has passed them. They wait in
chunks, each a run of up to ``CHUNK`` rows of one arrival, so adding rows never rewrites what waits, a quiet key costs one
chunk an arrival, and only chunks that overlap in the order are in memory at a time. A timer of the key stands at the event time of its first waiting row;
when it fires, rows are applied in order up to the first one that the watermark has not passed. A row is late
only if the key has already applied one at or behind its place, which a row inside the watermark never is.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK = 4096
ORDER, NUMBER, AT = "place_in_order", "tie_number", "at_millis"  # place in the order, tie-break, event time in milliseconds


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


class InOrder(StatefulProcessor):
    """``begin`` is the state of a key before its first row, ``apply`` takes it over ordered rows, ``late`` shows late ones.

    Input columns are the three names above and whatever ``apply`` reads; ``fields`` is the schema of the state.
    """

    fields = ""

    def begin(self) -> tuple:
        raise NotImplementedError

    def apply(self, key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, serial long", "rows binary")
        self.place = handle.getValueState("place", f"last_order long, last_number long, serial long, timer long, {self.fields}")

    def _load(self) -> tuple[tuple | None, int, int | None, tuple]:
        place = self.place.get()
        if place is None:
            return None, 0, None, self.begin()
        order, number, serial, timer, *own = place
        return (None if order is None else (order, number)), serial, timer, tuple(own)

    def _save(self, last: tuple | None, serial: int, timer: int | None, own: tuple) -> None:
        self.place.update((*(last or (None, None)), serial, timer, *own))

    def _wait(self, rows: pd.DataFrame, serial: int) -> int:
        rows = rows.sort_values([ORDER, NUMBER], kind="stable", ignore_index=True)
        for at in range(0, len(rows), CHUNK):
            part = rows[at:at + CHUNK]
            self.waiting.updateValue((int(part[ORDER].iloc[0]), serial), (_packed(part),))
            serial += 1
        return serial

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, serial, timer, own = self._load()
        first = timer
        for part in rows:
            if not len(part):
                continue
            if last is not None:
                behind = (part[ORDER] < last[0]) | ((part[ORDER] == last[0]) & (part[NUMBER] <= last[1]))
                if behind.any():
                    yield self.late(key, part[behind])
                    part = part[~behind]
                    if not len(part):
                        continue
            serial = self._wait(part, serial)
            soonest = int(part[AT].min()) + 1
            first = soonest if first is None else min(first, soonest)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self._save(last, serial, first, own)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, serial, timer, own = self._load()
        passed, timer = timerValues.getCurrentWatermarkInMs(), None
        places = sorted((int(f), int(n)) for f, n in self.waiting.keys())
        held: list[pd.DataFrame] = []
        for place, following in zip(places, [*places[1:], None]):
            held.append(_unpacked(self.waiting.getValue(place)[0]))
            self.waiting.removeKey(place)
            if following is not None and following[0] <= place[0]:
                continue
            rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            rows = rows.sort_values([ORDER, NUMBER], kind="stable", ignore_index=True)
            # from the first place of the next chunk on, its rows may come between
            known = len(rows) if following is None else int(rows[ORDER].searchsorted(following[0]))
            ahead = (rows[AT][:known] >= passed).to_numpy()
            due = int(ahead.argmax()) if ahead.any() else known
            if due:
                own, out = self.apply(key, own, rows[:due])
                last = int(rows[ORDER][due - 1]), int(rows[NUMBER][due - 1])
                yield out
            held = [rows[due:]] if due < len(rows) else []
            if due < known:
                timer = int(rows[AT][due]) + 1
                self.handle.registerTimer(timer)
                break
        for rows in held:
            serial = self._wait(rows, serial)
        self._save(last, serial, timer, own)

    def close(self) -> None:
        pass

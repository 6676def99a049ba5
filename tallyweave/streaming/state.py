"""Keyed state over streams: replay guard, failure limiter, revisions.

A key's rows of one micro-batch are judged in order of their sequence columns; between micro-batches the order of arrival
counts, as it does on any stream. A key's rows of one micro-batch are held together, so what a trigger may read bounds them.
With ``keep``, state that was not written for that long (processing time) expires: it suits queries that run on. With
``forget``, a key's state goes once the watermark is that far past its last event: by event time, so it holds for a query over what is
there now (``availableNow``) too; such a stream has a column ``event_time`` and rows later than ``late`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.governance import bumped, limited


class _Keyed(StatefulProcessor):
    """What all keyed states share: a key's rows in order, and a timer that clears its state."""

    order: tuple[str, ...] = ("event_id",)
    state_schema = ""

    def __init__(self, ttl: int | None = None, forget: int | None = None):
        self.ttl, self.forget = ttl, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", self.state_schema, self.ttl)

    def judged(self, part: pd.DataFrame, known: list[int]) -> tuple[dict[str, list], list[int]]:
        """(added columns, state afterwards), from a key's rows in order and its state."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        part = pd.concat(rows).sort_values(list(self.order))
        known = [int(r[0]) for r in self.state.get()] if self.state.exists() else []
        added, after = self.judged(part, known)
        if after:
            self.state.put([(int(x),) for x in after])
        else:
            self.state.clear()
        if self.forget is not None:
            self._wait_from(part["event_time"].max())
        yield part.assign(**added)

    def _wait_from(self, last: pd.Timestamp) -> None:
        """Clear the state ``forget`` after the key's last event."""
        due = (last.value // 1_000_000) + self.forget
        timers = list(self.handle.listTimers())
        if all(t < due for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Replay(_Keyed):
    state_schema = "last long"

    def judged(self, part: pd.DataFrame, known: list[int]) -> tuple[dict[str, list], list[int]]:
        last, accepted = known[0] if known else 0, []
        for n in part["sequence"]:
            accepted.append(bool(n > last))
            last = max(last, int(n))
        return {"accepted": accepted}, [last]


class _Limiter(_Keyed):
    order, state_schema = ("second", "event_id"), "second long"

    def __init__(self, most: int, window: int, ttl: int | None = None, forget: int | None = None):
        super().__init__(ttl, forget)
        self.most, self.window = most, window

    def judged(self, part: pd.DataFrame, known: list[int]) -> tuple[dict[str, list], list[int]]:
        out = list(limited(zip(part["second"], part["success"], strict=True), known, self.most, self.window))
        return {"status": [s for s, _ in out], "retry_after": [r for _, r in out]}, known


class _Revisions(_Keyed):
    state_schema = "revision long"

    def judged(self, part: pd.DataFrame, known: list[int]) -> tuple[dict[str, list], list[int]]:
        current = known or [0]
        out = list(bumped(part["expected"], current))
        return {"event": ["agent.write_ok" if s == "applied" else "agent.write_conflict" for s, _ in out], "revision": [r for _, r in out]}, current


def _stateful(stream: DataFrame, key: list[str], processor: Callable[..., StatefulProcessor], added: str, keep: timedelta | None, forget: timedelta | None = None, late: timedelta = timedelta(0)) -> DataFrame:
    ttl, after = (round(t.total_seconds() * 1000) if t else None for t in (keep, forget))
    if ttl and after:
        raise ValueError("state expires by processing time or by event time")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    timed = stream.withWatermark("event_time", f"{round(late.total_seconds() * 1000)} milliseconds") if after else stream
    mode = "eventTime" if after else "processingTime" if ttl else "none"
    return timed.groupBy(*key).transformWithStateInPandas(processor(ttl=ttl, forget=after), outputStructType=f"{columns}, {added}", outputMode="append", timeMode=mode)


def replay_guard_stream(messages: DataFrame, keep: timedelta | None = None, forget: timedelta | None = None, late: timedelta = timedelta(0)) -> DataFrame:
    """Messages (key, event_id, sequence) with accepted: the sequence is above all that its key has shown."""
    return _stateful(messages, ["key"], _Replay, "accepted boolean", keep, forget, late)


def auth_limiter_stream(attempts: DataFrame, most: int = 5, window: int = 60, keep: timedelta | None = None, forget: timedelta | None = None, late: timedelta = timedelta(0)) -> DataFrame:
    """Attempts (key, event_id, second, success) with status and retry_after, as auth_rate_limit judges them."""
    return _stateful(attempts, ["key"], partial(_Limiter, most, window), "status string, retry_after long", keep, forget, late)


def revision_stream(writes: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """Writes (path, event_id, expected) with the event to send and the path's revision.

    A path is one number of state; one that expires starts at 0 again, so by default none does.
    """
    return _stateful(writes, ["path"], _Revisions, "event string, revision long", keep)

"""A circuit breaker per caller, in event time, with timers.

Closed, calls go through, and failures in a row are counted; with ``most`` of
them the breaker opens.  Open, calls are skipped until the cool-down ends; a
timer then makes it half open.  Half open, the next call is a single probe: an
answer closes the breaker, a failure opens it for another cool-down.

Calls wait in the state until the watermark has passed them and are then taken
in order of time, however the batches came, so states do not depend on the
order of arrival within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
OUT = "user_id long, at timestamp, event_id long, state string, failures int, skipped int, open_until timestamp"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def step(state: tuple[str, int, int, int], at: int, failed: bool, most: int, cool: int) -> tuple[str, int, int, int]:
    """(state, failures in a row, skipped calls, open until) after a call at ``at``; times in microseconds."""
    kind, failures, skipped, until = state
    if kind == OPEN and at >= until:
        kind = HALF_OPEN
    if kind == OPEN:
        return kind, failures, skipped + 1, until
    if not failed:
        return CLOSED, 0, skipped, 0
    failures += 1
    return (OPEN, failures, skipped, at + cool) if kind == HALF_OPEN or failures >= most else (CLOSED, failures, skipped, 0)


def advance(state: tuple[str, int, int, int], calls: list[tuple[int, int, bool]], mark: int, most: int, cool: int) -> tuple[tuple, list[tuple]]:
    """The state at a watermark (milliseconds), and every state on the way, after calls (at, event, failed) in order that it has passed and at each cool-down's end."""
    out, i = [], 0
    while True:
        times = [calls[i][0] // 1000 + 1] if i < len(calls) else []
        times += [-(-state[3] // 1000)] if state[0] == OPEN else []
        if not times or min(times) > mark:
            return state, out
        now = min(times) * 1000
        while i < len(calls) and calls[i][0] < now:
            state = step(state, calls[i][0], calls[i][2], most, cool)
            out.append((calls[i][0], calls[i][1], *state))
            i += 1
        if state[0] == OPEN and now >= state[3]:
            state = (HALF_OPEN, state[1], state[2], 0)
            out.append((now, None, *state))


def stamps(micros: list[int]) -> pd.Series:
    """Timestamps, none where 0."""
    return pd.Series(np.array([t or np.iinfo(np.int64).min for t in micros], np.int64).view("datetime64[us]"))


class Breaker(StatefulProcessor):
    """State: the breaker, and the calls that the watermark has not passed."""

    def __init__(self, most: int, cool: int):
        self.most, self.cool = most, cool

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "state string, failures int, skipped int, until long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, failed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(t), int(e), bool(f)) for t, e, f in zip(at, batch["event_id"], batch["failed"], strict=True)])
            self.handle.registerTimer(int(at.min()) // 1000 + 1)  # once the watermark is past the first; that takes all it has passed
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        calls = sorted(tuple(x) for x in self.waiting.get())
        before = tuple(self.breaker.get()) if self.breaker.exists() else (CLOSED, 0, 0, 0)
        due = [c for c in calls if c[0] // 1000 + 1 <= mark]
        state, out = advance(before, due, mark, self.most, self.cool)
        left = calls[len(due) :]
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        if out:
            self.breaker.update(state)
        ahead = [c[0] // 1000 + 1 for c in left[:1]] + ([-(-state[3] // 1000)] if state[0] == OPEN else [])
        if out and ahead:
            self.handle.registerTimer(min(ahead))
        yield pd.DataFrame({
            "user_id": pd.Series([key[0]] * len(out), dtype="Int64"), "at": stamps([r[0] for r in out]), "event_id": pd.Series([r[1] for r in out], dtype="Int64"), "state": pd.Series([r[2] for r in out], dtype="object"),
            "failures": pd.Series([r[3] for r in out], dtype="int32"), "skipped": pd.Series([r[4] for r in out], dtype="int32"), "open_until": stamps([r[5] for r in out]),
        })

    def close(self) -> None:
        pass


def breakers(events: DataFrame, most: int = 3, cool_hours: float = 24.0, late: str = "1 day") -> DataFrame:
    """Every state that a user's breaker takes: after each call, and half open (event_id null) when a cool-down ends with no call.  The session needs ``STORE``."""
    calls = events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed")).withWatermark("ts", late)
    return calls.groupBy("user_id").transformWithStateInPandas(Breaker(most, int(cool_hours * 3_600_000_000)), OUT, "append", "EventTime")

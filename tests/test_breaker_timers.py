"""A breaker takes all that the watermark has passed with one timer and one read of its waiting calls."""

import random
from types import SimpleNamespace

import pandas as pd

from textloom.streaming import breaker as K


class State:
    def __init__(self):
        self.value, self.reads = None, 0

    def get(self):
        self.reads += 1
        return self.value or []

    def exists(self):
        return self.value is not None

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def put(self, rows):
        self.value = list(rows)

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None


def test_one_timer_and_one_read_a_batch():
    rng, cool = random.Random(2), 5_000_000
    times = sorted(rng.sample(range(1, 60_000_000), 200))
    calls = [(t, i, rng.random() < 0.6) for i, t in enumerate(times)]
    state, want = (K.CLOSED, 0, 0, 0), []
    for at, event, failed in calls:
        state = K.step(state, at, failed, 3, cool)
        want.append((event, state[0]))
    b, timers = K.Breaker(3, cool), []
    b.handle, b.breaker, b.waiting = SimpleNamespace(registerTimer=timers.append), State(), State()
    shuffled = rng.sample(calls, len(calls))
    frame = pd.DataFrame({"ts": pd.Series([c[0] for c in shuffled]).astype("datetime64[us]"), "event_id": [c[1] for c in shuffled], "failed": [c[2] for c in shuffled]})
    list(b.handleInputRows((1,), iter([frame]), None))
    assert timers == [times[0] // 1000 + 1]
    out = pd.concat(b.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])))
    got = out[out["event_id"].notna()]
    assert [(int(e), s) for e, s in zip(got["event_id"], got["state"], strict=True)] == want
    assert out["at"].is_monotonic_increasing and (out["event_id"].isna() & (out["state"] != K.HALF_OPEN)).sum() == 0
    assert b.waiting.reads == 1 and len(timers) == 1

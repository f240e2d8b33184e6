"""Structured Streaming forms of the incremental procedures over events.

Each takes a streaming DataFrame of events (event_id, ts, user_id, event_type,
value) and returns one; callers choose sink and trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def weekly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Teams per position in weeks that end on a Sunday."""
    w = F.window("ts", "7 days", startTime="4 days").alias("week")
    seen = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.approx_count_distinct("user_id").alias("teams"), F.count("*").alias("reads"))
    return seen.select(F.to_date(F.col("week.end") - F.expr("INTERVAL 1 DAY")).alias("snapshot"), F.col("event_type").alias("position"), "teams", "reads")


def daily_spend(events: DataFrame, zone: str = "America/Chicago", late: str = "1 day") -> DataFrame:
    """Spend per user and local day."""
    local = events.withWatermark("ts", late).withColumn("local", F.from_utc_timestamp("ts", zone))
    return local.groupBy("user_id", F.window("ts", "1 day", startTime="6 hours").alias("day")).agg(F.round(F.sum("value"), 4).alias("spent"))


def trailing(events: DataFrame, hours: int = 24, slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events in trailing windows of some hours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "event_type", "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, by its first event within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def late_rows(events: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Events on time and, apart, those of before ``day``, for the earlier topic."""
    early = F.col("ts") < F.lit(day).cast("timestamp")
    return events.filter(~early), events.filter(early)


PACED = "user_id long, event_id long, sent timestamp"


def paced(events: DataFrame, burst: int, spacing: float) -> DataFrame:
    """When a pacer per user releases each call: in order of arrival, at once, but never more than ``burst`` starts in ``burst * spacing`` seconds.

    A call starts when the one before it has, and ``burst * spacing`` after the
    start ``burst`` calls ago; the state is the last ``burst`` starts.
    """
    room = pd.Timedelta(seconds=burst * spacing)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts = [pd.Timestamp(x, unit="us") for x in state.get[0]] if state.exists else []
        rows = pd.concat([b[["ts", "event_id"]] for b in batches]).sort_values(["ts", "event_id"])  # one user's calls of one micro-batch
        sent = []
        for ts in rows["ts"]:
            begin = max([ts, *starts[-1:], *([starts[-burst] + room] if len(starts) >= burst else [])])
            starts = [*starts, begin][-burst:]
            sent.append(begin)
        state.update(([x.value // 1000 for x in starts],))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "sent": sent})

    return events.groupBy("user_id").applyInPandasWithState(step, PACED, "starts array<long>", "append", GroupStateTimeout.NoTimeout)


def joined_within(left: DataFrame, right: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """Stream-stream join: pairs of the same user with the right event at most some hours after the left one."""
    a = left.select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("a")).withWatermark("a_ts", late)
    b = right.select(F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b")).withWatermark("b_ts", late)
    near = F.expr(f"user_id = b_user AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {hours} HOURS")
    return a.join(b, near).select("user_id", "a", "b")

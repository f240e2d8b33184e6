"""Streaming queries, run to the end of what is there and returned as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.storage import settings, settled
from textloom.plans.ingest import place
from textloom.plans.registry import Tables, query
from textloom.sources.tail import tailed
from textloom.streaming import events as E
from textloom.streaming.breaker import STORE, breakers
from textloom.streaming.tables import WEEKS, StateTable, once, placed_once, snapshots


def stream(t: Tables):
    """The events table as a stream of its files."""
    raw = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    # a glob that matches the one file or folder, since a file source reads folders
    rows = t.spark.readStream.schema(raw.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(t: Tables, df, mode: str = "complete"):
    """Everything available, through the stream, into files of the shared folder: of complete output the last, of other modes every batch."""
    path, written = place(t, "stream"), []

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number}")  # a batch that is tried again writes the same folder
        written.append(number)

    q = df.writeStream.foreachBatch(save).option("checkpointLocation", place(t, "offsets")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    folders = [f"{path}/{n}" for n in (written[-1:] if mode == "complete" else written)]
    return t.spark.read.schema(df.schema).parquet(*folders) if folders else t.spark.createDataFrame([], df.schema)


@query("ST2_weekly_stream", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS DATE) AS snapshot, event_type AS position, count(*) AS reads FROM events GROUP BY 1, 2")
def weekly_stream(t):
    return finished(t, E.weekly(stream(t)).drop("teams"))


@query("ST3_daily_spend_stream", "SELECT user_id, round(sum(value), 4) AS spent, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day FROM events GROUP BY user_id, day")
def daily_spend_stream(t):
    return finished(t, E.daily_spend(stream(t))).select("user_id", "spent", F.to_date(F.col("day.start")).alias("day"))


@query("ST5_seen_once_stream", "SELECT count(*) AS events, count(DISTINCT event_id) AS keys FROM events")
def seen_once_stream(t):
    rows = finished(t, E.first_seen(stream(t)), "append")
    return rows.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("keys"))


#: weeks by their last day, in the order in which they come: every third a batch late
WEEK_ROWS = "w AS (SELECT DISTINCT CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS DATE) AS week, user_id AS key FROM events)"


@query("ST6_late_weeks", f"WITH {WEEK_ROWS}, f AS (SELECT key, min(week) AS first FROM w GROUP BY 1), n AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM w)) SELECT w.week AS week, count(*) AS held, count(*) FILTER (f.first = w.week) AS first_seen, count(p.key) AS returned, count(*) FILTER (p.key IS NULL AND f.first < w.week) AS back FROM w JOIN f USING (key) JOIN n USING (week) LEFT JOIN w p ON p.week = n.before AND p.key = w.key GROUP BY 1")
def late_weeks(t):
    """Weekly snapshots as a stream in which every third week comes after the two that follow it, measured again in place."""
    rows = t.events.select(F.date_add(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date"), 6).alias("week"), F.col("user_id").alias("key")).distinct()
    number = F.floor(F.datediff("week", F.lit("1970-01-04")) / 7)
    turn = F.when(number % 3 == 0, number + 2.5).otherwise(number)  # behind the two weeks after it
    source, table = place(t, "weeks"), StateTable(t.spark, place(t, "snapshots"), WEEKS)
    rows.withColumn("turn", turn).repartition("turn").write.partitionBy("turn").parquet(source)
    turns = sorted(r[0] for r in t.spark.read.parquet(source).select("turn").distinct().collect())  # a row a week
    save = once(table, snapshots)
    for n, turn in enumerate(turns):
        save(t.spark.read.parquet(source).filter(F.col("turn") == turn), n)
    out = table.rows()
    return out.groupBy("week").agg(F.count("*").alias("held"), F.count_if(F.col("first") == F.col("week")).alias("first_seen"), F.count_if("returned").alias("returned"), F.count_if(~F.col("returned") & (F.col("first") < F.col("week"))).alias("back"))


BREAKER_SQL = """WITH RECURSIVE m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
r AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events, m WHERE date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND <= date_trunc('millisecond', mark)),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'closed' AS state, 0 AS failures, 0 AS skipped, CAST(NULL AS TIMESTAMP) AS until FROM r GROUP BY 1
 UNION ALL SELECT r.user_id, r.n,
  CASE WHEN refused THEN 'open' WHEN NOT failed THEN 'closed' WHEN s.state = 'open' OR s.failures + 1 >= 3 THEN 'open' ELSE 'closed' END,
  CASE WHEN refused THEN s.failures WHEN NOT failed THEN 0 ELSE s.failures + 1 END, s.skipped + CASE WHEN refused THEN 1 ELSE 0 END,
  CASE WHEN refused THEN s.until WHEN failed AND (s.state = 'open' OR s.failures + 1 >= 3) THEN r.ts + INTERVAL 240 HOUR END
 FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1, LATERAL (SELECT s.state = 'open' AND r.ts < s.until AS refused) x)
SELECT user_id, event_id, state, failures, skipped, until AS open_until FROM s JOIN r USING (user_id, n)"""


@query("ST7_breaker_stream", BREAKER_SQL)
def breaker_stream(t):
    """The state of each user's breaker after each call that the watermark has passed, ten days of cool-down."""
    with settings(t.spark, STORE):
        rows = finished(t, breakers(stream(t), cool_hours=240.0), "append")
    return rows.filter("event_id is not null").select("user_id", "event_id", "state", "failures", "skipped", F.col("open_until").cast("timestamp_ntz").alias("open_until"))


@query("ST9_new_rows_only", "SELECT event_type AS key, min(event_id) AS event_id, min(user_id) AS user_id FROM (SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS event_type, event_id, user_id FROM events) GROUP BY 1")
def new_rows_only(t):
    """The first event of each user and kind, placed by two runs over growing input: the second run reads and writes only what is new."""
    rows = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "user_id")
    firsts = settled(rows.groupBy("key").agg(F.min("event_id").alias("event_id"), F.min("user_id").alias("user_id")))
    half = F.pmod(F.xxhash64("user_id"), F.lit(2)) == 0
    table = StateTable(t.spark, place(t, "placed"), "key string, event_id long, user_id long")
    save = once(table, placed_once)
    save(firsts.filter(half), 0)
    save(firsts, 1)
    save(firsts, 1)  # a batch that is tried again
    return table.rows()


@query("ST10_sessions_stream", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions_stream(t):
    return finished(t, E.sessions(stream(t))).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("ST1_tail_log", "SELECT event_id, user_id FROM events")
def tail_log(t):
    """Events logged as JSON lines, tailed by byte offsets while the logs lie in one folder."""
    path = place(t, "log")
    t.events.select("event_id", "user_id").write.json(path)
    lines = finished(t, tailed(t.spark, path, ".json"), "append")
    return lines.select(F.from_json("line", "event_id long, user_id long").alias("e")).select("e.*")


@query("ST8_paced_stream", "WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS came, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT user_id, event_id, n, came AS sent, [came] AS last FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.event_id, r.n, x.sent, list_append(s.last, x.sent)[-2:] FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1, LATERAL (SELECT greatest(r.came, s.last[-1], CASE WHEN len(s.last) = 2 THEN s.last[-2] + 7200000000 ELSE 0 END) AS sent) x) SELECT user_id, event_id, make_timestamp(sent) AS sent FROM s")
def paced_stream(t):
    """Each user's events as calls that a pacer releases: bursts of two, an hour a call."""
    return finished(t, E.paced(stream(t), burst=2, spacing=3600.0), "append").select("user_id", "event_id", F.col("sent").cast("timestamp_ntz").alias("sent"))


@query("ST11_joined_stream", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def joined_stream(t):
    """Clicks with the same user's purchases of the next six hours, as a join of two streams."""
    return finished(t, E.joined_within(stream(t).filter("event_type = 'click'"), stream(t).filter("event_type = 'purchase'")), "append")

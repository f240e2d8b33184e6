"""Normal forms and their maps, verification, snippets, budgets, tails, state tables and breakers."""

import io
import json
import random
import time
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import normal_form as N
from textloom.functions.storage import settings as session_settings
from textloom.operators import budgeted as B
from textloom.operators import offsets as O
from textloom.operators import snippets as P
from textloom.sources import tail as T
from textloom.streaming import breaker as K
from textloom.streaming import tables as S

ODD = "ab \t\n\r   ­​﻿ ȩ́각Åö́Åṩ"


def plain_normal(text):
    """The normal form character by character."""
    out, gap, breaks, parted, white = [], "", 0, False, False
    run = ""
    for i, c in enumerate(text):
        if c in N.GONE:
            continue
        if c in N.SPACES or c in N.BREAKS or c in N.PARTING:
            white = True
            breaks += c in N.BREAKS and not (c == "\r" and text[i + 1 : i + 2] == "\n")
            parted |= c in N.PARTING
            continue
        if white and (run or out):
            out.append(unicodedata.normalize("NFC", run))
            out.append("\n\n" if parted or breaks > 1 else " ")
            run = ""
        white, breaks, parted = False, 0, False
        run += c
    return "".join(out) + unicodedata.normalize("NFC", run)


@given(st.text(ODD, max_size=24))
@settings(max_examples=600, deadline=None)
def test_normal_form(text):
    normal, pieces = N.normal_form(text)
    assert normal == plain_normal(text)
    raw = at = 0
    for a, b, x, y, copied in pieces:  # the pieces cover both texts, and the copied ones are the same
        assert (a, x) == (raw, at) and b > a and y >= x and (not copied or text[a:b] == normal[x:y])
        raw, at = b, y
    assert (raw, at) == (len(text), len(normal))


def plain_carried(pieces, start, end, to_raw, n, other):
    side = [(p[2], p[3], p[0], p[1], p[4]) if to_raw else p for p in pieces]
    side = [p for p in side if p[0] < p[1]]
    if not 0 <= start <= end <= n:
        return None
    at = lambda i: next(p for p in side if p[0] <= i < p[1])
    begin = lambda i: (p := at(i))[2] + (i - p[0] if p[4] else 0)
    stop = lambda i: p[2] + i + 1 - p[0] if (p := at(i))[4] else p[3]
    if start < end:
        return begin(start), stop(end - 1)
    if start < n:
        return begin(start), begin(start)
    if not to_raw:
        return other, other
    return (stop(n - 1), stop(n - 1)) if n else (0, 0)


def test_spans_are_carried_both_ways(spark, monkeypatch):
    monkeypatch.setattr(O, "WIDTH", 5)
    rng = random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 40))) for _ in range(60)] + ["", None, "plain words only " * 20]
    forms = O.normal_forms(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").cache()
    for to_raw in (True, False):
        spans, want = [], {}
        for i, text in enumerate(texts):
            normal, pieces = N.normal_form(text) if text is not None else ("", [])
            n, other = (len(normal), len(text or "")) if to_raw else (len(text or ""), len(normal))
            for _ in range(12):
                span = (rng.randint(0, n), rng.randint(0, n + 1))
                spans.append((i, *span))
                if text is not None and (found := plain_carried(pieces, *span, to_raw, n, other)) is not None:
                    want[i, *span] = found
        got = O.carried(spark.createDataFrame(spans, "key long, start int, end int"), forms, to_raw).collect()
        assert {(r.key, r.start, r.end): (r.to_start, r.to_end) for r in got} == want and len(got) == len(want)


def test_mapping_back_gives_the_same_characters(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab \t\n", k=300)) for _ in range(20)]
    forms = O.normal_forms(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").cache()
    spans = [(i, a, a + rng.randint(1, 9)) for i, t in enumerate(texts) for a in range(0, len(N.normal_form(t)[0]) - 10, 7)]
    got = O.carried(spark.createDataFrame(spans, "key long, start int, end int"), forms, True).collect()
    assert len(got) == len(set(spans))
    for r in got:
        quoted = N.normal_form(texts[r.key])[0][r.start : r.end]
        assert N.normal_form(texts[r.key][r.to_start : r.to_end])[0] == quoted.strip(" \n") or quoted != quoted.strip(" \n")


@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
@settings(max_examples=30, deadline=None)
def test_first_difference(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None if a == b else min(len(a), len(b)))  # noqa: B905
    assert spark.range(1).select(O.first_difference(F.lit(a), F.lit(b)).alias("x")).first().x == want


def test_verification_codes(spark):
    text = "one two three four"
    sha = __import__("hashlib").sha256(text.encode()).hexdigest()
    snapshots = spark.createDataFrame([(1, text, sha), (2, text, "x" * 64)], "key long, normal string, sha256 string")
    none: list = []
    claims = [
        ("good", 1, 4, 13, none, "two three", sha, [(0, 3)]), ("cut", 1, 0, 18, [(4, 8)], "one three four", None, None), ("missing", 9, 0, 3, none, "one", None, None), ("damaged", 2, 0, 3, none, "one", None, None),
        ("other", 1, 0, 3, none, "one", "y" * 64, None), ("reversed", 1, 9, 3, none, "", None, None), ("outside", 1, 0, 99, none, "", None, None), ("empty cut", 1, 0, 18, [(4, 4)], text, None, None),
        ("differs", 1, 4, 13, none, "two thrae", sha, None), ("shorter", 1, 4, 13, none, "two", sha, None), ("mark", 1, 4, 7, none, "two", sha, [(0, 4)]), ("both", 1, 4, 7, none, "twx", sha, [(2, 2)]), ("null", 1, 4, 7, none, None, sha, None),
    ]
    df = spark.createDataFrame(claims, f"claim_id string, key long, start int, end int, omitted {O.SPANS}, text string, text_sha256 string, marks {O.SPANS}")
    got = {r.claim_id: (r.reasons, r.first_difference) for r in O.verified(df, snapshots).collect()}
    assert got == {
        "good": ([], None), "cut": ([], None), "missing": (["SNAPSHOT_MISSING"], None), "damaged": (["HASH_MISMATCH"], None), "other": (["HASH_MISMATCH"], None),
        "reversed": (["SPAN_OUT_OF_RANGE"], None), "outside": (["SPAN_OUT_OF_RANGE"], None), "empty cut": (["SPAN_OUT_OF_RANGE"], None), "differs": (["TEXT_MISMATCH"], 7),
        "shorter": (["TEXT_MISMATCH"], 3), "mark": (["SPAN_OUT_OF_RANGE"], None), "both": (["TEXT_MISMATCH", "SPAN_OUT_OF_RANGE"], 2), "null": (["TEXT_MISMATCH"], 0),
    }


def test_snippets_take_the_first_best_window(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Cat,", "dog", "eel", *"abcdefgh"], k=rng.randint(0, 60))) for _ in range(80)] + ["", None, "dog"]
    got = {r.key: r for r in P.best_windows(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", ["cat", "dog", "eel"], tokens=6).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        plain = [w.lower().strip(",") for w in words]
        best = max(((len({*plain[a : a + 6]} & {"cat", "dog", "eel"}), sum(p in ("cat", "dog", "eel") for p in plain[a : a + 6]), -a) for a in range(len(words)) if plain[a] in ("cat", "dog", "eel")), default=None)
        assert (i in got) == (best is not None)
        if best:
            start = max(0, min(-best[2], len(words) - 6))
            shown = " ".join(f"[{w}]" if p in ("cat", "dog", "eel") else w for w, p in list(zip(words, plain, strict=True))[start : start + 6])
            assert (got[i].start, got[i].found, got[i].hits) == (start, best[0], best[1])
            assert got[i].snippet == "…" * (start > 0) + shown + "…" * (start + 6 < len(words))


@pytest.mark.parametrize("files", [1, 6])
def test_search_stops_at_its_budget_and_resumes(spark, tmp_path, files):
    path = f"{tmp_path}/docs"
    spark.range(400).select("id", F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(None, "no id")], "id long, text string")).repartition(files).write.parquet(path)
    df = spark.read.parquet(path)

    @F.pandas_udf("string")
    def slow(x: pd.Series) -> pd.Series:
        time.sleep(2.5)
        return x

    search = lambda rows: rows.select("id", slow("text").alias("text"))
    cursor = B.begin(df, "id", "all", ranges=6)
    assert not B.advance(df, "id", cursor, "all", search, 0.0) and B.found(spark, cursor, df.schema).count() == 0
    assert not B.advance(df, "id", cursor, "all", search, 8.0)
    part = B.found(spark, cursor, df.schema)
    first = B.finished(spark, cursor)
    assert 0 < len(first) < 6 and 0 < part.count() < 401
    with pytest.raises(B.WrongCursor):
        B.advance(df, "id", cursor, "other", search, None)
    assert B.advance(df, "id", cursor, "all", lambda rows: rows, None)
    assert {k: B.finished(spark, cursor)[k] for k in first} == first  # what was done is not done again
    assert sorted(map(str, B.found(spark, cursor, df.schema).collect())) == sorted(map(str, df.collect()))


def test_a_search_that_fails_is_no_late_one(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    cursor = B.begin(df, "id", "a", ranges=2)
    with pytest.raises(Exception, match="broken"):
        B.advance(df, "id", cursor, "a", lambda rows: rows.select(F.raise_error(F.lit("broken")).alias("id")), 60.0)


@given(st.lists(st.binary(max_size=9).filter(lambda x: b"\n" not in x), max_size=12), st.integers(1, 12), st.binary(max_size=4).filter(lambda x: b"\n" not in x))
@settings(max_examples=200, deadline=None)
def test_every_line_is_in_one_range(lines, size, tail):
    data = b"".join(x + b"\n" for x in lines) + tail
    stop = T.whole_lines(io.BytesIO(data), 0, len(data))
    assert stop == len(data) - len(tail)
    reader = T.TailReader({"path": "", "rangeBytes": str(size)})
    got = [x for part in reader.partitions({}, {"f": stop}) for x in T.lines_of(io.BytesIO(data), part)]
    at, want = 0, []
    for x in lines:
        want.append((at, x))
        at += len(x) + 1
    assert got == want


def test_tail_gives_each_line_once(spark, tmp_path):
    log, out, state = tmp_path / "log", tmp_path / "out", tmp_path / "state"
    log.mkdir()

    def run():
        q = T.tailed(spark, str(log)).writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        return sorted((r.file[-1], r.at, r.line) for r in spark.read.parquet(str(out)).collect())

    (log / "a").write_text("one\ntw")
    assert run() == [("a", 0, "one")]
    with (log / "a").open("a") as f:
        f.write("o\r\nthree\nfo")
    (log / "b").write_text("first\n")
    assert run() == [("a", 0, "one"), ("a", 4, "two"), ("a", 9, "three"), ("b", 0, "first")]
    assert len(run()) == 4
    with (log / "a").open("a") as f:
        f.write("ur\n")
    assert ("a", 15, "four") in run()


def test_late_weeks_rewrite_only_what_they_change(spark, tmp_path):
    table = S.StateTable(spark, f"file://{tmp_path}/weeks", S.WEEKS)
    save = S.once(table, S.snapshots)
    weeks = {"2024-01-07": [1, 2, 3], "2024-01-14": [2, 3, 4], "2024-01-21": [3, 4, 5], "2024-01-28": [3, 6]}
    frame = lambda *names: spark.createDataFrame([(w, k) for w in names for k in weeks[w]], "week string, key long")

    def want(*names):
        out, names = set(), sorted(names)
        for i, w in enumerate(names):
            for k in weeks[w]:
                out.add((w, k, min(x for x in names if k in weeks[x]), i > 0 and k in weeks[names[i - 1]]))
        return out

    state = lambda: {(str(r.week), r.key, str(r.first), r.returned) for r in table.rows().collect()}
    save(frame("2024-01-07"), 0)
    save(frame("2024-01-21"), 1)
    save(frame("2024-01-28"), 2)
    assert state() == want("2024-01-07", "2024-01-21", "2024-01-28")
    before = table.folders()
    save(frame("2024-01-14"), 3)  # late: the week after it changes, and so does every week with a key first seen in it
    assert state() == want(*weeks)
    after = table.folders()
    assert after["2024-01-07"] == before["2024-01-07"] and after["2024-01-28"] == before["2024-01-28"] and after["2024-01-21"] != before["2024-01-21"]
    save(frame("2024-01-14"), 3)  # the same batch again
    assert state() == want(*weeks) and table.version() == 4
    assert {(str(r.week), r.key) for r in table.rows(version=3).collect()} == {(w, k) for w in weeks if w != "2024-01-14" for k in weeks[w]}


def test_a_batch_that_fails_before_its_commit_is_repeated(spark, tmp_path):
    table = S.StateTable(spark, f"file://{tmp_path}/placed", "key string, n long")
    save = S.once(table, S.placed_once)
    frame = lambda rows: spark.createDataFrame(rows, "key string, n long")
    save(frame([("a", 1), ("b", 2)]), 0)
    real, spark_frame = table._entries, spark.createDataFrame

    def broken(version):
        raise OSError("lost")

    table._entries = broken
    with pytest.raises(OSError):
        save(frame([("b", 9), ("c", 3)]), 1)
    table._entries = real
    assert spark_frame and {(r.key, r.n) for r in table.rows().collect()} == {("a", 1), ("b", 2)}
    save(frame([("b", 9), ("c", 3), ("c", 3)]), 1)
    assert {(r.key, r.n) for r in table.rows().collect()} == {("a", 1), ("b", 2), ("c", 3)} and table.rows().count() == 3
    save(frame([]), 2)
    assert table.rows().count() == 3


def test_breaker_states_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(7)
    minute = 60_000_000
    calls = sorted((u, 1_704_067_200_000_000 + rng.randrange(600) * minute + u, u * 1000 + i, rng.random() < 0.6) for u in range(6) for i in range(40))
    schema = "user_id long, t long, event_id long, failed boolean"
    shuffled = calls[:]
    rng.shuffle(shuffled)
    source = f"{tmp_path}/in"
    for i in range(4):  # files in one order of time, rows in none
        part = spark.createDataFrame(shuffled[i::4], schema).select("user_id", "event_id", F.timestamp_micros("t").alias("ts"), F.when(F.col("failed"), "error").otherwise("view").alias("event_type"))
        part.coalesce(1).write.mode("append").parquet(source)
    for i in range(2):  # the watermark passes all calls, and then the cool-downs
        last = spark.createDataFrame([(99, 1_704_067_200_000_000 + (5000 + i) * minute, 99_999 + i, False)], schema).select("user_id", "event_id", F.timestamp_micros("t").alias("ts"), F.lit("view").alias("event_type"))
        last.coalesce(1).write.mode("append").parquet(source)
    out = []
    with session_settings(spark, K.STORE):
        stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = K.breakers(stream, cool_hours=1.0, late="1 day").writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.event_id: (r.state, r.failures, r.skipped) for r in out if r.event_id is not None}
    want = {}
    for u in range(6):
        state = (K.CLOSED, 0, 0, 0)
        for _, t, event, failed in (c for c in calls if c[0] == u):
            state = K.step(state, t, failed, 3, 60 * minute)
            want[event] = state[:3]
    assert got == want and {s for s, _, _ in want.values()} == {"open", "closed"}
    assert any(r.state == "half_open" and r.event_id is None for r in out)  # timers, not calls


def test_breaker_probe():
    step = lambda s, at, failed: K.step(s, at, failed, 2, 10)
    s = step(step((K.CLOSED, 0, 0, 0), 0, True), 1, True)
    assert s == (K.OPEN, 2, 0, 11)
    assert step(s, 5, False) == (K.OPEN, 2, 1, 11)  # refused, whatever it would have been
    assert step(s, 11, True) == (K.OPEN, 3, 0, 21) and step(s, 11, False) == (K.CLOSED, 0, 0, 0)


def test_logs_that_shrink_are_refused():
    with pytest.raises(T.ShrunkLog):
        T.TailReader({"path": ""}).partitions({"f": 9}, {"f": 3})
    assert json.loads(json.dumps(T.TailReader({"path": ""}).initialOffset())) == {}

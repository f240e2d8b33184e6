"""Cursors, fields, running sums, feeds and bad lines."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import decoding as D
from textloom.operators import cohorts as C
from textloom.operators import edits as ED
from textloom.operators import pages as P
from textloom.sources import records as R


def test_pages_follow_cursors(spark, tmp_path):
    spark.range(25).select("id", (F.col("id") % 4).alias("score")).write.parquet(f"{tmp_path}/a")
    spark.range(25).select("id", (F.col("id") % 4).alias("score")).write.parquet(f"{tmp_path}/b")
    rows, order = spark.read.parquet(f"{tmp_path}/a"), [F.desc("score"), F.asc("id")]
    seen, cursor = [], None
    while True:
        found, cursor = P.page(rows, order, 10, "all", cursor)
        seen += [r.id for r in found.collect()]
        if cursor is None:
            break
    assert seen == sorted(range(25), key=lambda i: (-(i % 4), i))
    _, cursor = P.page(rows, order, 10, "all")
    for wrong in (lambda: P.page(rows, order, 10, "other", cursor), lambda: P.page(spark.read.parquet(f"{tmp_path}/b"), order, 10, "all", cursor), lambda: P.page(rows, order, 10, "all", "nonsense")):
        with pytest.raises(P.WrongCursor):
            wrong()


def test_running_sums_by_ranges(spark):
    rng = random.Random(1)
    levels = {round(rng.random(), 3): (rng.randint(0, 5), rng.randint(5, 9)) for _ in range(300)}
    got = {r.score: (r.hits, r.n) for r in C.running_sums(spark.createDataFrame([(k, *v) for k, v in levels.items()], "score double, hits long, n long"), "score", ["hits", "n"], parts=7).collect()}
    assert got == {k: tuple(sum(v[i] for s, v in levels.items() if s >= k) for i in (0, 1)) for k in levels}
    none = spark.createDataFrame([], "score double, hit int")
    assert C.precision_threshold(none, 0.5).first().threshold is None


def test_feeds(spark):
    rss = '<rss><channel><title>c</title><item><title>A &amp; B</title><link>http://a</link><pubDate>d</pubDate></item><item><title>two</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>one</title><link rel="edit" href="http://e"/><link href="http://o"/><updated>u</updated><content>c</content></entry></feed>'
    rows = R.feed_entries(spark.createDataFrame([(1, rss), (2, atom), (3, "no feed"), (4, None)], "id long, xml string"), "id", "xml").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "A & B", "http://a", "d", None), (1, 1, "two", None, None, None), (2, 0, "one", "http://o", "u", "c")]


def test_a_bad_line_is_named(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in R.strict_jsonl(spark, str(log), "a long").collect()) == [1, 2]
    (log / "b.jsonl").write_text('{"a": 1}\n\n{"a": "x"}\nno json\n')
    (log / "c.jsonl").write_text('{"a": 1}\n{"a": 3')  # a last line without its end counts as well
    found = {r.file[-7:]: (r.line, r.text) for r in R.bad_lines(spark, str(log), "a long").collect()}
    assert found == {"b.jsonl": (3, '{"a": "x"}'), "c.jsonl": (2, '{"a": 3')}
    with pytest.raises(R.BadLine, match="b.jsonl: line 3"):
        R.strict_jsonl(spark, str(log), "a long")


def test_bodies_are_decoded_strictly(spark):
    rows = [
        (1, "é".encode(), None, "é", None), (2, "é".encode("latin-1"), None, None, "malformed"), (3, "é".encode("latin-1"), "text/html; charset='latin1'", "é", None),
        (4, b'<meta charset="iso-8859-1">\xe9', None, '<meta charset="iso-8859-1">é', None), (5, b'<META http-equiv=x content="text/html; charset=utf-8">\xe9', None, None, "malformed"),
        (6, b"\xef\xbb\xbf" + "é".encode(), "charset=latin1", "é", None), (7, "\ufeffé".encode("utf-16-le"), None, "é", None), (8, b"a\x80", "charset=ascii", None, "malformed"), (9, b"a", "charset=koi8-r", None, "unknown charset"), (10, None, None, None, "no body"), (11, b"", None, "", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, body binary, header string").withColumn("c", D.charset_of(F.col("body"), F.col("header")))
    got = {r.id: (r.d.text, r.d.problem) for r in df.select("id", D.decoded(F.col("body"), F.col("c")).alias("d")).collect()}
    assert got == {r[0]: r[3:] for r in rows}


def test_edits_of_quotations(spark):
    rng = random.Random(5)
    text = "abcdefghij"
    rows = [("DELETE_RANGE", 2, 5, [2, 5]), ("DELETE_RANGE", 2, 5, [3]), ("DELETE_RANGE", 5, 2, []), ("DELETE_RANGE", 0, 10, []), ("DELETE_RANGE", 8, 11, []), ("MOVE", 0, 1, []), ("EDIT_TAG", None, None, []), ("ELSE", 0, 1, []), (None, 0, 1, [])]
    df = spark.createDataFrame(rows, "kind string, a int, b int, held array<int>")
    got = [r[0] for r in df.select(ED.refusal(F.col("kind"), F.col("a"), F.col("b"), F.lit(10), F.col("held"))).collect()]
    assert got == [None, "INTERPOLATION", "OUT_OF_RANGE", "NOTHING_LEFT", "OUT_OF_RANGE", "FORBIDDEN", None, "UNKNOWN", "UNKNOWN"]
    cases = [(*sorted(rng.sample(range(11), 2)), [sorted(rng.sample(range(11), 2)) for _ in range(rng.randint(0, 4))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b, [tuple(m) for m in marks]) for i, (a, b, marks) in enumerate(cases)], "i int, a int, b int, marks array<struct<start:int,end:int>>")
    for r in df.select("i", ED.without(F.lit(text), F.col("a"), F.col("b")).alias("t"), ED.marks_without(F.col("marks"), F.col("a"), F.col("b")).alias("m")).collect():
        a, b, marks = cases[r.i]
        left = text[:a] + text[b:]
        assert r.t == left and "".join(left[m.start : m.end] for m in r.m) == "".join(c for k, c in enumerate(text) if not a <= k < b and any(x <= k < y for x, y in marks))

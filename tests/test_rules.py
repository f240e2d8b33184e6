"""Operators on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textloom.operators import classification as K
from textloom.operators import entities as N
from textloom.operators import matching as M
from textloom.operators import retrieval as R
from textloom.operators import snapshots as S


def test_pair_shape_boundaries(spark):
    rows = [(0, 10, 10), (98, 100, 100), (97, 100, 100), (9, 10, 40), (9, 10, 30), (9, 10, 29), (3, 10, 50), (2, 10, 50)]
    df = spark.createDataFrame(rows, "s int, a int, b int").select(M.pair_shape(F.col("s"), F.col("a"), F.col("b")))
    want = ["nothing", "identical", "contained, large", "contained, small", "contained, large", "contained, large", "overlapping", "a little"]
    assert [r[0] for r in df.collect()] == want


def test_withdrawn_and_superseded(spark):
    earlier = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, "z", "r")], "snapshot int, sha256 string, path string")
    archive = spark.createDataFrame([("z", "r"), ("w", "q")], "sha256 string, path string")
    assert S.count_withdrawals(earlier, archive).first().asDict() == {"withdrawn": 1, "superseded": 1, "earlier_snapshots": 2}


def test_entities_and_veto(spark):
    rows = [(1, "d1", None, "en"), (2, "d1", "u1", "en"), (3, None, "u1", "en"), (4, "d2", None, "en"), (5, "d2", None, "de"), (6, None, None, "en")]
    df = spark.createDataFrame(rows, "id long, doi string, url string, lang string")
    found = N.resolved(df, ["doi", "url"], ["lang"])
    assert dict(found.collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    merged = {r.entity: (r.members, r.url) for r in N.merged(df, found, [F.col("id")], ["url"]).collect()}
    assert merged[1] == (3, "u1") and merged[6] == (1, None)


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "")], "doc_id long, text string")
    got = dict(R.bm25(df, ["a", "a"]).collect())
    import math

    idf, mean = math.log(1 + (3 - 1 + 0.5) / 1.5), 5 / 3
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))) and got[2] == got[3] == 0
    assert R.bm25(df, []).filter("bm25 is not null").count() == 0


def test_weights_are_checked():
    with pytest.raises(ValueError):
        R.Weights(bm25=-1)
    with pytest.raises(ValueError):
        R.Weights.parse({"bm25": 1.0})


def test_placement_order(spark):
    rows = [(1, ["a", "b"], ["x"]), (2, ["a"], ["k"]), (3, ["n"], ["k", "m"]), (4, ["n"], ["k"]), (5, ["a", "zz"], ["x"]), (6, ["a"], ["c", "k"]), (7, ["b", "zz"], ["c"]), (8, ["a"], ["c", "d"])]
    items = spark.createDataFrame(rows, "id long, headings array<string>, tag array<string>")
    overrides = spark.createDataFrame([("b", "over"), ("n", None)], "heading string, position string")
    aliases = spark.createDataFrame([("a", "alias"), ("b", "alias2")], "heading string, position string")
    words = spark.createDataFrame([("k", "key", None), ("m", "more", None), ("c", "child", "alias"), ("d", "other child", "alias")], "word string, position string, parent string")
    got = {r.id: (r.position, r.confidence, r.method) for r in K.placed(items, overrides, aliases, words).collect()}
    assert got == {
        1: ("over", 1.0, "override"), 2: ("alias", 1.0, "alias"), 3: (None, None, None), 4: ("key", 0.5, "keyword"), 5: ("alias", 0.9, "inherited"),
        6: ("child", 0.9, "keyword"), 7: ("over", 0.9, "inherited"), 8: ("alias", 1.0, "alias"),
    }


def test_as_of_is_strictly_before(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    rows = spark.createDataFrame([("a", d(1), 1), ("a", d(3), 3)], "k string, t timestamp, v int")
    times = spark.createDataFrame([("a", d(1)), ("a", d(2)), ("a", d(4)), ("b", d(4))], "k string, t timestamp")
    got = {(r.k, r.t.day): r.before and r.before.v for r in S.latest_as_of(rows, times, "k", "t").collect()}
    assert got == {("a", 1): None, ("a", 2): 1, ("a", 4): 3, ("b", 4): None}


def test_ordered_clusters_refuse_weak_pairs(spark):
    sets = {1: list("abcdefghij"), 2: list("abcdefghi") + ["x"], 3: ["i", "x", "p", "q", "r", "s", "t", "u", "v", "w"]}
    s = spark.createDataFrame([(k, v) for k, v in sets.items()], "id long, shingles array<string>")
    pairs = spark.createDataFrame([(1, 2, 9, 10, 10), (2, 3, 2, 10, 10)], "a long, b long, shared int, n int, m int")
    assert dict(M.ordered_clusters(pairs, s).collect()) == {1: 1, 2: 1, 3: 3}


def test_quoted_runs(spark):
    text = [str(i) for i in range(30)]
    t = spark.createDataFrame([(1, ["x"] + text[5:20] + ["y"])], "id long, words array<string>")
    s = spark.createDataFrame([(7, text)], "id long, words array<string>")
    assert [tuple(r) for r in M.quoted_runs(t, s).select("text_id", "source_id", "words", "start", "source_start").collect()] == [(1, 7, 15, 2, 6)]


def test_cut_step(spark):
    clusters = spark.createDataFrame([(i, i) for i in range(1, 9)], "id long, cluster long")
    held = [(1, 2, 50, 100), (2, 3, 100, 200), (1, 3, 50, 200), (4, 5, 5, 100), (6, 7, 50, 60), (6, 8, 50, 70)]
    rows = spark.createDataFrame(held, "part long, holder long, n int, m int")
    got = dict(M.cut_step(clusters, rows).collect())
    # 1 and then 2 come to 3; 4 is too small a share of 5; 6 has two witnesses that don't hold each other
    assert got == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}

"""Text functions on rows written by hand, and their properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import search_query as Q
from textloom.functions import text as X
from textloom.functions import web as W


def values(spark, column, rows, name="t"):
    df = spark.createDataFrame([(r,) for r in rows], f"{name} string")
    return [r[0] for r in df.select(column).collect()]


def test_matching_form(spark):
    rows = ["“Hi”  there", "a‑b—c", "x y", "soft­hyphen", None, ""]
    assert values(spark, X.normalize_ascii(F.col("t")), rows) == ['"hi" there', "a-b-c", "x y", "softhyphen", None, ""]


def test_unicode_form(spark):
    assert values(spark, X.normalize_for_matching("t"), ["Straße ﬁn ＡＢ", None]) == ["strasse fin ab", None]


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_unicode_form_is_stable(text):
    once = X.normalized(text)
    assert X.normalized(once) == X.normalized(X.normalized(once))


def test_shingles(spark):
    rows = ["a b c d e f", "a b", "", "x x x x x x x"]
    got = values(spark, X.shingles(X.words(F.col("t")), 5), rows)
    assert got == [["a b c d e", "b c d e f"], ["a b"], [], ["x x x x x"]]


def test_dehyphenated_words(spark):
    assert values(spark, X.matching_words(F.col("t")), ["exam- ple well-known"]) == [["example", "well", "known"]]


def test_headings(spark):
    df = spark.createDataFrame([("1. AT: Trade -- Bad",), ("2AC - Capital",), ("Economy",)], "t string").select(X.heading(F.col("t")).alias("h"))
    assert [(r.h.text, r.h.answer) for r in df.collect()] == [("trade bad", True), ("capital", False), ("economy", False)]


def test_cutter_mark(spark):
    assert values(spark, X.cutter_mark(F.col("t")), ["body // AB\n\n", "see http://x", "none"]) == ["AB", None, None]


def test_canonical_url_rules():
    assert W.canonical("HTTP://M.Example.com:80/a/../b/amp?utm_source=x&b=2&a=1#f") == "http://example.com/b?a=1&b=2"
    assert W.canonical("https://www.google.com/url?q=https://a.test/x%3Futm_medium%3Dy") == "https://a.test/x"
    assert W.canonical("mailto:x@y") is None and W.canonical(None) is None


@given(st.sampled_from(["http", "https"]), st.sampled_from(["a.test", "m.b.example.org", "x.co.uk"]), st.text("abc/.%20é", max_size=12), st.lists(st.tuples(st.sampled_from(["a", "utm_x", "b"]), st.text("xy1", max_size=3)), max_size=4))
@settings(max_examples=100, deadline=None)
def test_canonical_url_is_stable(scheme, host, path, query):
    once = W.canonical(f"{scheme}://{host}/{path}?" + "&".join(f"{k}={v}" for k, v in query))
    assert W.canonical(once) == once


def test_page_content():
    html = '<html><head><title>T &amp; t</title><script>x</script><meta name="author" content="A B"></head><body><div><p>One <b>two</b></p><p></p></div><li>three</li></body>'
    page = W.read_page(html)
    assert (page["text"], page["title"], page["author"], page["paywalled"]) == ("One two\nthree", "T & t", "A B", False)
    assert W.read_page(None)["text"] == ""


def test_query_grammar():
    terms = Q.parse('climate "carbon tax" -tag:neg author:smith econ*')
    assert [(t.text, t.phrase, t.excluded, t.prefix, t.field) for t in terms] == [
        ("climate", False, False, False, None), ("carbon tax", True, False, False, None), ("neg", False, True, False, "tag"), ("smith", False, False, False, "author"), ("econ", False, False, True, None),
    ]
    for bad in ("-a", "ab*", "x " * 300):
        try:
            Q.parse(bad)
        except Q.QueryRefused:
            continue
        raise AssertionError(bad)


def test_intervals(spark):
    from textloom.functions import intervals as I

    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 9), (1, 3), (3, 4), (8, 12))))
    row = spark.range(1).select(I.union(spans).alias("u"), I.subtract(F.lit(0), F.lit(10), spans).alias("s"), I.length(I.union(spans)).alias("n")).first()
    assert [(x.start, x.end) for x in row.u] == [(1, 4), (5, 12)]
    assert [(x.start, x.end) for x in row.s] == [(0, 1), (4, 5)] and row.n == 10


def test_stems():
    from textloom.functions.stem import search_tokens, stem

    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "sized": "size", "happy": "happi", "relational": "relat", "sensitivity": "sensit", "adoption": "adopt", "roll": "roll", "controll": "control"}
    assert {w: stem(w) for w in pairs} == pairs
    assert search_tokens("Élections, élection's") == ["elect", "elect", "s"] and search_tokens(None) is None

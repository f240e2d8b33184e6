"""Pages with cut references, long urls and characters that XML does not hold give the rows of their SQL."""

import duckdb

from textloom.plans.registry import ORACLES, QUERIES

PAGES = "page_id long, url string, html string"


def same_rows(spark, folder, name, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_links_of_long_urls_are_decoded(spark, tmp_path):
    urls = ["http://a.test/", "http://blog.casino-win.example.net/en/48615?utm_source=feed", "http://a.test/" + "é" * 300, "", None]
    same_rows(spark, tmp_path, "X17_decoded_links", [(i, u, "") for i, u in enumerate(urls)])


TITLES = ["Fish &amp; chips", "cut &amp", "cut &am", "R&D &copy;", "a &lt;b&gt;", 'say "x"', "  two  spaces ", "\n lead", "cr\r\nlf", "", "   ", "v\x0bt", "c\x01d", "\xa0nb ", "&amp;lt;", "x\x85y z"]


def test_titles_with_cut_references(spark, tmp_path):
    same_rows(spark, tmp_path, "X6_page_titles", [*((i, "", f"<title>{x}</title>") for i, x in enumerate(TITLES)), (100, "", None), (101, "", "<TITLE>up</TITLE><p>none")])


def test_feeds_of_titles_that_are_no_xml(spark, tmp_path):
    rows = [(i * 2 + k, f"http://{host}/{i}?a=1&b=\"'<>\t\x02", f"<title>{x}</title>") for i, x in enumerate(TITLES) for k, host in enumerate(("a.test", "bb.test"))]
    same_rows(spark, tmp_path, "S5_feed_entries", [*rows, (3, "http://a.test/n", None), (100, "http://bb.test/n", None), (101, None, "<title>x</title>"), (102, "no host", "")])

"""Queries of the source and sink family. Those that need files write them to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import search_query as Q
from textloom.functions.storage import shared_folder
from textloom.functions.text import trimmed, words
from textloom.plans.registry import Tables, query
from textloom.sources import archives as A
from textloom.sources import records as R


def place(t: Tables, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/ingest/{uuid.uuid4().hex}/{name}"


@query("S7_jsonl_round_trip", "SELECT event_id, user_id, value FROM events")
def jsonl_round_trip(t):
    path = place(t, "events")
    t.events.select("event_id", "user_id", "value").write.json(path)
    return R.read_jsonl(t.spark, path, "event_id long, user_id long, value double")


@query("S8_parsed_store", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr'")
def parsed_store(t):
    path = place(t, "parsed")
    t.documents.select("doc_id", "lang", "n_chars").write.partitionBy("lang").parquet(path)
    return t.spark.read.parquet(path).filter("lang = 'fr'").select("doc_id", "lang", "n_chars")


HTML_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("S5_feed_entries", f"SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS INTEGER) AS position, replace(trim({HTML_TITLE}), '&amp;', '&') AS title, url AS link, CAST(length(html) AS VARCHAR) AS snippet FROM (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE url IS NOT NULL)")
def feed_entries(t):
    """The pages of each host as its feed, Atom where the host's name has an even length, and the feeds read back."""
    title = F.replace(trimmed(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("&amp;"), F.lit("&"))
    pages = t.pages.filter("url is not null").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", R.xml_escaped(F.col("url")).alias("link"), R.xml_escaped(title).alias("title"), F.length("html").cast("string").alias("n"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))  # noqa: E731  (what a page lacks, its entry lacks)
    rss = tag("item", F.concat(tag("title", F.col("title")), tag("link", F.col("link")), tag("description", F.col("n"))))
    atom = tag("entry", F.concat(tag("title", F.col("title")), F.lit('<link rel="self" href="x"/><link href="'), F.col("link"), F.lit('"/>'), tag("summary", F.col("n"))))
    # a page whose feed is longer than its titles and links is no case here: an entry is a few hundred bytes
    body = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", c.alias("x")))), lambda e: e["x"]), "")
    even = F.length("host") % 2 == 0
    whole = lambda begin, c, end: F.concat(F.lit(R.XML_HEAD + begin), body(c), F.lit(end))
    feeds = pages.groupBy("host").agg(F.when(even, whole('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>', atom, "</feed>")).otherwise(whole("<rss><channel><title>f</title>", rss, "</channel></rss>")).alias("xml"))
    return R.feed_entries(feeds, "host", "xml", trim=False).select("host", "position", "title", "link", "snippet")


@query("S7_first_bad_line", "WITH l AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, value FROM events) SELECT event_type, min(line) AS line FROM l WHERE value > 150 GROUP BY 1")
def first_bad_line(t):
    """A log for each kind of event, whose large values are written as words: of each log the line that refuses it."""
    path = place(t, "events")
    value = F.when(F.col("value") > 150, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit(' or so"'))).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"value":'), value, F.lit("}"))
    rows = t.events.select("event_type", "event_id", line.alias("line")).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    rows.select("event_type", "line").write.partitionBy("event_type").text(path)
    kinds = sorted(r[0] for r in t.events.select("event_type").distinct().collect())  # kinds of events
    out = None
    for kind in kinds:  # a log each
        bad = R.bad_lines(t.spark, f"{path}/event_type={kind}", "event_id long, value double").select(F.lit(kind).alias("event_type"), "line")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("S9_keyset_pages", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 20")
def keyset_pages(t):
    return t.customer.filter("c_custkey > 40").select("c_custkey", "c_name").orderBy("c_custkey").limit(20)


@query("S10_inverted_index", "WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN ('the', 'eaan', 'thand') GROUP BY 1, 2")
def inverted_index(t):
    path = place(t, "index")
    R.write_index(t.documents.select("doc_id", "text"), path, parts=8)
    found = R.search_index(t.spark, path, ["the", "eaan", "thand"], parts=8)
    return found.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"))


@query("S11_manifest_lines", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def manifest_lines(t):
    return R.manifest_lines(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("S12_csv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(t):
    path = place(t, "parts")
    R.write_csv(t.part.select("p_partkey", "p_name", "p_size"), path, ["p_partkey"])
    return t.spark.read.schema("p_partkey long, p_name string, p_size int").option("header", "true").option("mode", "FAILFAST").csv(path)


@query("S13_decisions", "SELECT doc_id, quality, CASE WHEN n > 1 THEN 'repeated key' WHEN quality NOT IN (1) THEN 'value' END AS problem FROM (SELECT doc_id, quality, count(*) OVER (PARTITION BY doc_id) AS n FROM labels)")
def decisions(t):
    path = place(t, "decisions")
    t.labels.select("doc_id", "quality").write.option("header", "true").csv(path)
    good, refused = R.read_decisions(t.spark, path, "doc_id long, quality string", "doc_id", {"quality": ["1"]})
    rows = good.withColumn("problem", F.lit(None).cast("string")).unionByName(refused)
    return rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "problem")


@query("R18_search_grammar", "WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') || ' ' AS b, ' ' || lang || ' ' AS g FROM documents) SELECT doc_id FROM t WHERE (contains(b, ' the ') OR contains(g, ' the ')) AND (contains(b, ' of the ') OR contains(g, ' of the ')) AND NOT (contains(b, ' idiot ') OR contains(g, ' idiot ')) AND (contains(b, ' thi') OR contains(g, ' thi')) AND contains(g, ' en ')")
def search_grammar(t):
    terms = Q.parse('the "of the" -idiot thi* tag:en')
    return t.documents.filter(Q.matches(terms, {"text": F.col("text"), "tag": F.col("lang")})).select("doc_id")


@query("J8_postings_match", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS term FROM documents) SELECT doc_id, count(*) AS found FROM t WHERE term IN ('the', 'of', 'eaan', 'thand') GROUP BY 1 HAVING count(*) >= 3")
def postings_match(t):
    terms = t.spark.createDataFrame([("the",), ("of",), ("eaan",), ("thand",)], "term string")
    p = t.documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return p.join(terms, "term").groupBy("doc_id").agg(F.count("*").alias("found")).filter("found >= 3")


@query("J6_anchor_join", "WITH w AS (SELECT item_id, string_split(text, ' ')[1:3] AS o, string_split(text, ' ')[-3:] AS c FROM benchmark), g AS (SELECT o, c, min(item_id) AS \"full\", count(*) AS holders FROM w GROUP BY 1, 2) SELECT item_id AS short, \"full\", holders FROM w JOIN g USING (o, c)")
def anchor_join(t):
    """Each short body with the first body between the same anchors, and how many there are: one row a body, not a pair."""
    w = t.benchmark.select("item_id", F.split("text", " ").alias("w")).select("item_id", F.slice("w", 1, 3).alias("opening"), F.slice("w", -3, 3).alias("closing"))
    full = w.groupBy("opening", "closing").agg(F.min("item_id").alias("full"), F.count("*").alias("holders"))
    return w.join(full, ["opening", "closing"]).select(F.col("item_id").alias("short"), "full", "holders")


@query("R15_expanded_queries", "WITH v AS (SELECT n_name FROM nation), q AS (SELECT t.place, lower(replace(t.template, '{x}', n_name)) AS query, t.since FROM v CROSS JOIN (VALUES (0, '{x} policy', 30), (1, 'policy of {x}', 7), (2, '{x} policy', 365)) AS t (place, template, since)) SELECT query, min(place) AS place, arg_min(since, place) AS since FROM q GROUP BY 1")
def expanded_queries(t):
    templates = t.spark.createDataFrame([(0, "{x} policy", 30), (1, "policy of {x}", 7), (2, "{x} policy", 365)], "place int, template string, since int")
    q = t.nation.crossJoin(F.broadcast(templates)).withColumn("query", F.lower(F.replace("template", F.lit("{x}"), "n_name")))  # lists of a configuration
    return q.groupBy("query").agg(F.min("place").alias("place"), F.min_by("since", "place").alias("since"))


@query("S1_zip_members", "SELECT item_id || '.zip' AS archive, CASE WHEN item_id % 5 = 0 THEN '__MACOSX/x' ELSE 'a.txt' END AS member, CASE WHEN item_id % 5 <> 0 THEN sha256(text) END AS sha256, CASE WHEN item_id % 5 = 0 THEN 'junk' END AS skipped FROM benchmark")
def zip_members(t):
    i = F.col("item_id").cast("string")
    name = F.when(F.col("item_id") % 5 == 0, "__MACOSX/x").otherwise("a.txt")
    files = t.benchmark.select(F.concat(i, F.lit(".zip")).alias("path"), A.zipped(name, F.col("text")).alias("content"))
    return A.members_of(files).drop("size")


@query("S2_docx_paragraphs", "WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[0-9A-Za-z.,]+$')) AS w FROM benchmark) SELECT item_id || '.docx' AS file, 0 AS paragraph, 'Tag' AS style, array_to_string(w[1:5], ' ') AS text, CAST(0 AS INTEGER) AS runs FROM w UNION ALL SELECT item_id || '.docx', 1, NULL, array_to_string(w[6:15], ' ') || ' ' || array_to_string(w[16:], ' '), CAST(CASE WHEN len(w) > 15 THEN 1 ELSE 0 END AS INTEGER) FROM w")
def docx_paragraphs(t):
    """Files whose tag is the first words of an item, and whose body the others, bold from the sixteenth on; read back."""
    i, w = F.col("item_id").cast("string"), F.filter(F.split("text", " "), lambda x: x.rlike("^[0-9A-Za-z.,]+$"))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = F.concat(
        F.lit(f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Tag"/></w:pPr><w:r><w:t>'), part(1, 5), F.lit("</w:t></w:r></w:p><w:p><w:r><w:t>"), part(6, 10),
        F.lit(" </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>"), part(16, 1000), F.lit("</w:t></w:r></w:p></w:body></w:document>"),
    )
    files = t.benchmark.select(F.concat(i, F.lit(".docx")).alias("path"), A.zipped(F.lit("word/document.xml"), xml).alias("content"))
    return A.paragraphs_of(files).select("file", "paragraph", "style", "text", F.size("runs").alias("runs"))


CANDIDATE = "struct<title:string,html_url:string,publication_date:string,agencies:array<struct<name:string>>,abstract:string>"


@query("S6_provider_records", "SELECT p_partkey, p_name AS title, 'https://docs.test/' || p_partkey AS url, p_brand || '; ' || p_type AS authors, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS published, p_size > 25 AS scholarly FROM part WHERE p_name IS NOT NULL")
def provider_records(t):
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("https://docs.test/"), F.col("p_partkey").cast("string")).alias("html_url"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd").alias("publication_date"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("agencies")))
    rows = t.part.select("p_partkey", "p_size", body.alias("body")).select("p_partkey", "p_size", F.from_json("body", CANDIDATE).alias("r")).filter("r.title is not null")
    return rows.select("p_partkey", F.col("r.title").alias("title"), F.col("r.html_url").alias("url"), F.array_join("r.agencies.name", "; ").alias("authors"), F.to_date("r.publication_date").alias("published"), (F.col("p_size") > 25).alias("scholarly"))

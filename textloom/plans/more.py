"""Further queries: ranking tokens, titles, identifier vetoes, stems, page layout, trailing windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.stem import stemmed_tokens
from textloom.operators import entities as N
from textloom.operators import layout as L
from textloom.operators import retrieval as R
from textloom.plans.registry import query
from textloom.plans.streams import finished, stream
from textloom.streaming import events as E


@query("R1_ranking_tokens", "WITH s AS (SELECT c_custkey, 'The U.S. Labour Party''s ' || c_mktsegment || ' defence of ' || c_name AS s FROM customer), j AS (SELECT c_custkey, regexp_replace(regexp_replace(lower(s), '''s([^0-9a-z]|$)', '\\1', 'g'), '([a-z])[''.]([a-z])', '\\1\\2', 'g') AS s FROM s) SELECT c_custkey, array_to_string(list_transform(list_filter(string_split(regexp_replace(s, '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: CASE x WHEN 'labour' THEN 'labor' WHEN 'defence' THEN 'defense' ELSE x END), ' ') AS tokens FROM j")
def ranking_tokens(t):
    s = F.concat(F.lit("The U.S. Labour Party's "), "c_mktsegment", F.lit(" defence of "), "c_name")
    return t.customer.select("c_custkey", F.array_join(X.ranking_tokens(s), " ").alias("tokens"))


TITLE = "trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^0-9a-z]+', ' ', 'g'))"
SITE = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


def titled(t):
    """(page_id, title, site, n): the words of each page's title, its host and the length of its html."""
    title, site = X.tag_words(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    return t.pages.select("page_id", title.alias("title"), site.alias("site"), F.length("html").alias("n"))


@query("R14_title_rule", f"WITH k AS (SELECT page_id, {TITLE} AS title, {SITE} AS site, length(html) // 4000 AS year FROM pages), g AS (SELECT title, site, year, min(page_id) AS entity, count(*) AS members FROM k WHERE len(string_split(title, ' ')) >= 3 GROUP BY 1, 2, 3) SELECT entity, members FROM g WHERE members > 1")
def title_rule(t):
    keyed = titled(t).withColumn("year", F.floor(F.col("n") / 4000)).filter(F.size(F.split("title", " ")) >= 3)
    return keyed.groupBy("title", "site", "year").agg(F.min("page_id").alias("entity"), F.count("*").alias("members")).filter("members > 1").select("entity", "members")


PRECEDENCE = "WITH r AS (SELECT md5(text) AS entity, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS p, doc_id FROM documents) SELECT entity, count(*) AS members, arg_min(lang, (p, doc_id)) FILTER (lang IS NOT NULL) AS lang, arg_min(source, (p, doc_id)) FILTER (source IS NOT NULL) AS source FROM r GROUP BY 1 HAVING count(*) > 1"


@query("R13_precedence_merge", PRECEDENCE)
def precedence_merge(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("p"))
    entities = rows.select("id", F.col("body").alias("entity"))
    return N.merged(rows, entities, [F.col("p"), F.col("id")], ["lang", "source"]).filter("members > 1")


@query("R13b_date_gate", f"WITH k AS (SELECT {TITLE} AS title, CASE WHEN length(html) % 2 = 0 THEN 'y' || (length(html) // 4000) ELSE 'd' || (page_id % 5) || {SITE} END AS gate, page_id FROM pages) SELECT title, gate, min(page_id) AS entity, count(*) AS members FROM k GROUP BY 1, 2")
def date_gate(t):
    # scholarly records share the year, all others the day and the site
    gate = F.when(F.col("n") % 2 == 0, F.concat(F.lit("y"), F.floor(F.col("n") / 4000).cast("string"))).otherwise(F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string"), "site"))
    return titled(t).groupBy("title", gate.alias("gate")).agg(F.min("page_id").alias("entity"), F.count("*").alias("members"))


@query("R13c_identifier_veto", "WITH g AS (SELECT l_orderkey AS entity, count(DISTINCT l_suppkey) AS openalex, count(DISTINCT l_returnflag) AS doi, count(DISTINCT l_linestatus) AS pmid FROM lineitem GROUP BY 1) SELECT entity, pmid > 1 OR (openalex > 1 AND doi <> 1) AS apart FROM g")
def identifier_veto(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("entity")).agg(F.count_distinct("l_suppkey").alias("openalex"), F.count_distinct("l_returnflag").alias("doi"), F.count_distinct("l_linestatus").alias("pmid"))
    return g.select("entity", ((F.col("pmid") > 1) | ((F.col("openalex") > 1) & (F.col("doi") != 1))).alias("apart"))


@query("R16_mechanism_crossing", "SELECT t.place * 100 + n_nationkey AS place, t.template || ' via ' || lower(n_name) AS query FROM nation CROSS JOIN (VALUES (0, 'trade policy'), (1, 'energy policy')) AS t (place, template) WHERE n_regionkey = 1")
def mechanism_crossing(t):
    templates = t.spark.createDataFrame([(0, "trade policy"), (1, "energy policy")], "place int, template string")
    both = F.broadcast(templates).crossJoin(t.nation.filter("n_regionkey = 1"))  # two lists of a configuration, template first
    return both.select((F.col("place") * 100 + F.col("n_nationkey")).alias("place"), F.concat("template", F.lit(" via "), F.lower("n_name")).alias("query"))


@query("R21_stemmed_postings")
def stemmed_postings(t):
    rows = t.documents.select("doc_id", F.explode(stemmed_tokens("text")).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("doc_id").alias("df")).filter("df > 1")


@query("W1_global_rank", "SELECT event_id, row_number() OVER (ORDER BY round(value, 1) DESC, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END DESC NULLS LAST, event_id) AS rank FROM events QUALIFY rank <= 100")
def global_rank(t):
    rows = t.events.select("event_id", F.round("value", 1).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("at"))
    order = [F.desc("v"), F.desc_nulls_last("at"), F.asc("event_id")]
    return rows.orderBy(*order).limit(100).select("event_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # the best hundred


@query("W10_ngram_frames", "WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark), b AS (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w WHERE len(w) > 1) SELECT bigram, count(*) AS n FROM b GROUP BY 1")
def ngram_frames(t):
    return t.benchmark.select(F.explode(X.word_runs(X.words(F.col("text")), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("T5_capped_results", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def capped_results(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5)


LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents), r AS (SELECT doc, i // 6 AS page, i % 6 + 1 AS line, text FROM l), h AS (SELECT * FROM r UNION ALL SELECT DISTINCT doc, page, 0, 'Running head ' || page FROM r)"


@query("X7_page_layout", f"WITH {LINES}, e AS (SELECT *, line = min(line) OVER w OR line = max(line) OVER w AS edge, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS mask FROM h WINDOW w AS (PARTITION BY doc, page)), p AS (SELECT doc, count(DISTINCT page) AS pages FROM h GROUP BY 1), k AS (SELECT doc, mask FROM e JOIN p USING (doc) WHERE edge GROUP BY doc, mask, pages HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) >= pages * 0.5) SELECT e.doc, count(*) AS lines, sum(length(text)) AS characters FROM e LEFT JOIN k ON k.doc = e.doc AND k.mask = e.mask WHERE NOT (edge AND k.doc IS NOT NULL) AND NOT (edge AND regexp_matches(trim(text), '^[0-9]+$')) GROUP BY 1")
def page_layout(t):
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = lines.select("doc", F.floor(F.col("i") / 6).alias("page"), (F.col("i") % 6 + 1).alias("line"), "text")
    heads = rows.select("doc", "page").distinct().select("doc", "page", F.lit(0).alias("line"), F.concat(F.lit("Running head "), F.col("page").cast("string")).alias("text"))
    kept = L.body_lines(rows.unionByName(heads))
    return kept.groupBy("doc").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("characters"))


@query("X7_joined_text", "SELECT doc_id AS doc, md5(regexp_replace(regexp_replace(text, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '\\n', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def joined_text(t):
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = lines.select("doc", F.floor(F.col("i") / 6).alias("page"), (F.col("i") % 6 + 1).alias("line"), "text")
    return L.joined_text(rows).select("doc", F.md5("text").alias("text"))


@query("ST4_trailing_stream", "WITH w AS (SELECT event_type, date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6 + 1 + d) AS until FROM events, (SELECT unnest([0, 1, 2, 3]) AS d)) SELECT until, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def trailing_stream(t):
    return finished(t, E.trailing(stream(t))).select(F.col("until").cast("timestamp_ntz").alias("until"), "event_type", "n")


@query("A21_narrowing_subjects", "WITH e AS (SELECT n_name AS subject, o_orderkey AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT count(DISTINCT rank) AS carrying FROM e) SELECT subject, count(*) AS results, min(rank) AS best_rank FROM e, c GROUP BY subject, carrying HAVING count(*) >= 2 AND count(*) < carrying ORDER BY results DESC, best_rank, subject LIMIT 5")
def narrowing_subjects(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.narrowing(j.select(F.col("o_orderkey").alias("rank"), F.array("n_name").alias("subjects")), [])


@query("A43_vanished_kinds", "SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS superseded, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS withdrawn FROM orders WHERE o_orderstatus = 'P'")
def vanished_kinds(t):
    there = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("path"), F.lit(True).alias("there"))
    gone = t.orders.filter("o_orderstatus = 'P'").join(there, F.col("o_custkey") == F.col("path"), "left")
    return gone.agg(F.count_if(F.col("there").isNotNull()).alias("superseded"), F.count_if(F.col("there").isNull()).alias("withdrawn"))


"""Queries of the join and set families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import entities as N
from textloom.operators import snapshots as S
from textloom.operators.cohorts import readings
from textloom.plans.cohorts import EV
from textloom.plans.registry import query

#: two snapshots of documents: doc_id % 11 = 0 arrives later, % 13 = 0 leaves, % 7 = 0 changes
SNAPS = """b AS (SELECT doc_id AS path, md5(text) AS sha256 FROM documents WHERE doc_id % 11 <> 0),
a AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS sha256 FROM documents WHERE doc_id % 13 <> 0)"""


def snaps(t):
    d = t.documents
    before = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("sha256"))
    after = d.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("sha256"))
    return before, after


@query("J1_dictionary_lookup", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name <> 'FRANCE'")
def dictionary_lookup(t):
    return t.customer.join(t.nation.filter("n_name <> 'FRANCE'"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


PATH = "p AS (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '^[^?#]*'), '/'), lambda x: x <> '')) AS part, generate_subscripts(list_filter(string_split(regexp_extract(url, '^[^?#]*'), '/'), lambda x: x <> ''), 1) AS depth FROM pages)"


@query("J2_nearest_ancestor", f"WITH {PATH}, k AS (SELECT * FROM (VALUES ('https:', 'secure'), ('en', 'english'), ('de', 'german'), ('fr', 'french')) AS v (alias, position)), m AS (SELECT page_id, position, depth, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) AS r FROM p JOIN k ON part = alias) SELECT page_id, position, CAST(depth AS BIGINT) AS depth FROM m WHERE r = 1")
def nearest_ancestor(t):
    known = t.spark.createDataFrame([("https:", "secure"), ("en", "english"), ("de", "german"), ("fr", "french")], "alias string, position string")
    parts = F.filter(F.split(F.regexp_extract("url", "^[^?#]*", 0), "/"), lambda x: x != "")
    p = t.pages.select("page_id", F.posexplode(parts).alias("at", "part"))
    m = p.join(known, F.col("part") == F.col("alias"))
    return m.groupBy("page_id").agg(F.max_by("position", "at").alias("position"), (F.max("at") + 1).cast("bigint").alias("depth"))


KEYWORDS = [("the", "english"), ("und", "german"), ("les", "french"), ("los", "spanish")]
KEYWORD_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{p}')" for w, p in KEYWORDS) + ") AS v (word, position))"
TAG = "trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'))"


@query("J3_keyword_unique", f"WITH {KEYWORD_SQL}, g AS (SELECT doc_id, ' ' || {TAG} || ' ' AS tag FROM documents) SELECT doc_id, min(position) AS position FROM g JOIN k ON contains(tag, ' ' || word || ' ') GROUP BY 1 HAVING count(DISTINCT position) = 1")
def keyword_unique(t):
    words = t.spark.createDataFrame(KEYWORDS, "word string, position string")
    tag = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")), " ")
    g = t.documents.select("doc_id", F.explode(F.array_distinct(tag)).alias("word"))  # words, so that the join is on equality
    return g.join(words, "word").groupBy("doc_id").agg(F.min("position").alias("position"), F.count_distinct("position").alias("n")).filter("n = 1").drop("n")


@query("J7_representative", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 WHERE o_totalprice > 100000")
def representative(t):
    return t.orders.filter("o_totalprice > 100000").join(t.lineitem.filter("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_quantity")


@query("J9_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("J10_withdrawals", f"WITH {SNAPS}, g AS (SELECT * FROM b WHERE sha256 NOT IN (SELECT sha256 FROM a)), k AS (SELECT sha256, bool_or(path IN (SELECT path FROM a)) AS s FROM g GROUP BY 1) SELECT count(*) FILTER (NOT s) AS withdrawn, count(*) FILTER (s) AS superseded, 1 AS earlier_snapshots FROM k")
def withdrawals(t):
    before, after = snaps(t)
    return S.count_withdrawals(before.withColumn("snapshot", F.lit(1)), after)


@query("J11_snapshot_diff", f"""WITH {SNAPS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'REMOVED' WHEN b.path IS NULL AND a.sha256 IN (SELECT sha256 FROM b) THEN 'DUPLICATE' WHEN b.path IS NULL THEN 'NEW' WHEN a.sha256 = b.sha256 THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (path)""")
def snapshot_diff(t):
    before, after = snaps(t)
    return S.snapshot_diff(before, after, "path", "sha256")


@query("J12_as_of_previous", "SELECT e.event_id, (SELECT max_by(b.value, (b.ts, b.event_id)) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND b.ts < e.ts) AS before_value FROM events e WHERE e.event_type = 'error'")
def as_of_previous(t):
    rows = t.events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    rows = rows.groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    errors = t.events.filter("event_type = 'error'")
    times = errors.select("user_id", "ts").distinct()
    found = S.latest_as_of(rows, times, "user_id", "ts")
    return errors.select("event_id", "user_id", "ts").join(found, ["user_id", "ts"]).select("event_id", F.col("before.value").alias("before_value"))


RECORDS = "r AS (SELECT doc_id AS id, md5(text) AS body, CASE WHEN doc_id % 9 = 0 THEN CAST(doc_id // 90 AS VARCHAR) END AS doi, lang FROM documents)"


@query("J13_entity_resolution", f"""WITH RECURSIVE {RECORDS}, k AS (SELECT id, 'body:' || body AS key FROM r UNION ALL SELECT id, 'doi:' || doi FROM r WHERE doi IS NOT NULL),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key)), c AS (SELECT id, id AS label FROM r UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.id),
f AS (SELECT id, min(label) AS entity FROM c GROUP BY 1), v AS (SELECT entity, count(DISTINCT lang) > 1 AS clash FROM f JOIN r USING (id) GROUP BY 1)
SELECT f.id, CASE WHEN clash THEN f.id ELSE entity END AS entity FROM f JOIN v USING (entity)""")
def entity_resolution(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("body"), F.when(F.col("doc_id") % 9 == 0, F.floor(F.col("doc_id") / 90).cast("string")).alias("doi"), "lang")
    return N.resolved(d, ["body", "doi"], ["lang"])


@query("J14_fact_dimensions", "SELECT r_name, n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3")
def fact_dimensions(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("J15_seen_before", f"WITH {EV}, s AS (SELECT DISTINCT round AS key, day FROM ev WHERE position = 'view') SELECT event_id AS id, day FROM ev e WHERE position = 'signup' AND NOT EXISTS (SELECT 1 FROM s WHERE s.key IN (e.round, e.round + 1) AND s.day <> e.day)")
def seen_before(t):
    r = readings(t.events)
    seen = r.filter("position = 'view'").select(F.col("round").alias("key"), "day").distinct()
    rows = r.filter("position = 'signup'").select(F.col("event_id").alias("id"), "day", F.array(F.col("round"), F.col("round") + 1).alias("keys"))
    return S.unseen(rows, seen, "day").select("id", "day")


@query("J16_match_or_register", "SELECT p.page_id, coalesce(min(d.doc_id), -p.page_id - 1) AS article FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 3 AND d.lang = 'en' GROUP BY p.page_id")
def match_or_register(t):
    j = t.pages.join(t.documents.filter("lang = 'en'").select("doc_id"), F.col("doc_id") == F.col("page_id") * 3, "left")
    return j.groupBy("page_id").agg(F.coalesce(F.min("doc_id"), -F.col("page_id") - 1).alias("article"))


@query("J17_versioned_cache", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE toxic = 0 GROUP BY 1) l USING (doc_id)")
def versioned_cache(t):
    cache = t.labels.filter("toxic = 0").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("kept"))
    return t.documents.join(cache, "doc_id", "left").select("doc_id", "quality", F.col("kept").isNotNull().alias("hit"))


TOPICS = [("opening", "2024-01-01", "2024-01-09"), ("middle", "2024-01-10", "2024-01-19"), ("closing", "2024-01-20", "2024-01-28")]
TOPIC_SQL = "k AS (SELECT topic, CAST(a AS DATE) AS a, CAST(z AS DATE) AS z FROM (VALUES " + ", ".join(str(x) for x in TOPICS) + ") AS v (topic, a, z))"


@query("J18_interval_join", f"WITH {EV}, {TOPIC_SQL} SELECT event_id, CASE WHEN position = 'signup' THEN 'opening' ELSE coalesce(k.topic, (SELECT max_by(topic, z) FROM k k2 WHERE k2.z < day)) END AS topic FROM ev LEFT JOIN k ON day BETWEEN a AND z")
def interval_join(t):
    # the ranges do not overlap, so the one that holds a day is the last that begins by then
    topics = t.spark.createDataFrame(TOPICS, "topic string, a string, z string").select("topic", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    days = topics.select("topic", F.explode(F.sequence("a", "z")).alias("day"))
    last = topics.agg(F.max_by("topic", "z").alias("last"), F.max("z").alias("end"))
    r = readings(t.events).join(days, "day", "left").crossJoin(F.broadcast(last))  # one row
    late = F.when(F.col("day") > F.col("end"), F.col("last"))
    return r.select("event_id", F.when(F.col("position") == "signup", "opening").otherwise(F.coalesce("topic", late)).alias("topic"))


@query("J19_range_overlap", "WITH s AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 6 HOUR AS z FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts AS a, ts + INTERVAL 6 HOUR AS z FROM events WHERE event_type = 'purchase') SELECT s.event_id AS span, p.event_id AS other FROM s JOIN p ON s.user_id = p.user_id AND s.a < p.z AND p.a < s.z")
def range_overlap(t):
    def spans(kind, name):
        e = t.events.filter(F.col("event_type") == kind)
        return e.select(F.col("event_id").alias(name), "user_id", F.col("ts").alias(f"{name}_a"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias(f"{name}_z"))

    # a span of 6 hours meets two cells of that length, so overlapping ones share a cell
    def cells(df, name):
        cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(21_600_000_000))
        return df.withColumn("cell", F.explode(F.sequence(cell(f"{name}_a"), cell(f"{name}_z"))))

    j = cells(spans("signup", "span"), "span").join(cells(spans("purchase", "other"), "other"), ["user_id", "cell"])
    return j.filter("span_a < other_z and other_a < span_z").select("span", "other").distinct()


@query("J20_template_products", "SELECT n_name || ' ' || r.word AS query, n_nationkey * 3 + r.turn AS place FROM nation CROSS JOIN (VALUES ('policy', 0), ('trade', 1), ('energy', 2)) AS r (word, turn)")
def template_products(t):
    words = t.spark.createDataFrame([("policy", 0), ("trade", 1), ("energy", 2)], "word string, turn int")
    both = t.nation.crossJoin(F.broadcast(words))  # templates by variables, both lists of a configuration
    return both.select(F.concat("n_name", F.lit(" "), "word").alias("query"), (F.col("n_nationkey") * 3 + F.col("turn")).alias("place"))


@query("U1_union_dedupe", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def union_dedupe(t):
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))).distinct()


@query("U2_difference", "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def difference(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).exceptAll(t.supplier.select("s_nationkey"))


@query("U3_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("U4_listing_diff", f"WITH {SNAPS} SELECT CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL THEN 'upload' WHEN a.sha256 <> b.sha256 THEN 'replace' ELSE 'keep' END AS action, count(*) AS n FROM a FULL JOIN b USING (path) GROUP BY 1")
def listing_diff(t):
    before, after = snaps(t)
    j = after.select("path", F.col("sha256").alias("local")).join(before.select("path", F.col("sha256").alias("remote")), "path", "full_outer")
    action = F.when(F.col("local").isNull(), "delete").when(F.col("remote").isNull(), "upload").when(F.col("local") != F.col("remote"), "replace").otherwise("keep")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("U5_multiset_equality", "WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey % 5 <> 0), b AS (SELECT l_orderkey, l_partkey FROM lineitem) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right")
def multiset_equality(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey")
    return S.same_rows(t.lineitem.filter("l_suppkey % 5 <> 0").select("l_orderkey", "l_partkey"), rows)


@query("U6_pending", "SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def pending(t):
    return t.labels.filter("toxic = 1").join(t.labels.filter("quality = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("U8_exclusion_counts", "SELECT count(*) FILTER (lang = 'de') AS same_language, count(*) FILTER (n_chars < 200) AS too_short, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (lang = 'de' OR n_chars < 200 OR doc_id IN (SELECT doc_id FROM labels)) AS excluded FROM documents")
def exclusion_counts(t):
    known = t.labels.select("doc_id", F.lit(True).alias("known")).distinct()
    d = t.documents.join(known, "doc_id", "left")
    a, b, c = F.col("lang") == "de", F.col("n_chars") < 200, F.col("known").isNotNull()
    return d.agg(F.count_if(a).alias("same_language"), F.count_if(b).alias("too_short"), F.count_if(c).alias("labelled"), F.count_if(a | b | c).alias("excluded"))


@query("P3_suppressed", f"WITH {EV} SELECT event_id FROM ev WHERE round NOT IN (SELECT round FROM ev WHERE position = 'error' AND round IS NOT NULL)")
def suppressed(t):
    r = readings(t.events)
    return r.filter("round is not null").join(r.filter("position = 'error'").select("round").distinct(), "round", "left_anti").select("event_id")


@query("P4_live_disclosures", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def live_disclosures(t):
    a = t.lineitem.join(t.orders.filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return a.join(t.supplier.filter("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("W5_top_and_more", "WITH g AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, n_chars, place, greatest(n - 3, 0) AS more FROM g WHERE place <= 3")
def top_and_more(t):
    w = Window.partitionBy("source")
    g = t.documents.select("source", "doc_id", "n_chars", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("place"), F.count("*").over(w).alias("n"))
    return g.filter("place <= 3").select("source", "doc_id", "n_chars", "place", F.greatest(F.col("n") - 3, F.lit(0)).alias("more"))

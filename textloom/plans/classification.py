"""Queries of the classification and predicate families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.storage import settled
from textloom.operators import assignment as A
from textloom.operators import classification as K
from textloom.operators import matching as M
from textloom.operators.cohorts import readings
from textloom.plans.cohorts import EV
from textloom.plans.registry import query

TAG = "trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'))"


@query("C2_tag_words", f"SELECT item_id, {TAG} AS tag FROM benchmark")
def tag_words(t):
    return t.benchmark.select("item_id", X.tag_words(F.col("text")).alias("tag"))


HEAD = "CASE l_linenumber WHEN 1 THEN '1. AT: ' WHEN 2 THEN '2AC - ' WHEN 3 THEN 'A2 ' ELSE '' END || l_returnflag || ' -- Trade' || CAST(l_suppkey % 5 AS VARCHAR)"
PLAIN = f"trim(regexp_replace(lower({HEAD}), '^([0-9]+[.)]|[0-9]?(ac|nc|ar|nr)[ :-])[ ]*', ''))"
MARKER = "'^(a2|at|answers? to|ans)[ :-]+'"


@query("C1_headings", f"WITH h AS (SELECT DISTINCT {PLAIN} AS plain FROM lineitem) SELECT DISTINCT trim(regexp_replace(regexp_replace(plain, {MARKER}, ''), '[ ]*-+[ ]*', ' ', 'g')) AS heading, regexp_matches(plain, {MARKER}) AS answer FROM h")
def headings(t):
    n = F.col("l_linenumber")
    raw = F.concat(F.when(n == 1, "1. AT: ").when(n == 2, "2AC - ").when(n == 3, "A2 ").otherwise(""), "l_returnflag", F.lit(" -- Trade"), (F.col("l_suppkey") % 5).cast("string"))
    return t.lineitem.select(X.heading(raw).alias("h")).select(F.col("h.text").alias("heading"), "h.answer").distinct()


#: the tree that placing uses: overrides and aliases of headings, and keywords with the place that they are under
OVERRIDES = (("src3/en", "special"), ("src4", None))
ALIASES = (("src1", "first"), ("de", "german"), ("src2/fr", "second"), ("src5/en", "first"))
KEYWORDS = (("thand", "alpha", "first"), ("inea", "beta", "first"), ("heer", "alpha", "first"), ("oned", "gamma", "german"), ("the", "delta", "special"), ("reha", "epsilon", None))


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


PLACED = f"""h AS (SELECT doc_id AS id, unnest([source, lang, source || '/' || lang]) AS heading, unnest([0, 1, 2]) AS depth FROM documents),
o AS (SELECT heading, position, 0 AS kind FROM (VALUES {_values(OVERRIDES)}) AS v (heading, position) UNION ALL SELECT heading, position, 1 FROM (VALUES {_values(ALIASES)}) AS v (heading, position)),
b AS (SELECT id, position, kind, depth = 2 AS direct FROM h JOIN o USING (heading) WHERE kind = 1 OR position IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC, kind, position DESC) = 1),
w AS (SELECT * FROM (VALUES {_values(KEYWORDS)}) AS v (word, pos, parent)),
k AS (SELECT x.id, min(pos) AS by_word FROM (SELECT doc_id AS id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' '))) AS word FROM documents) x JOIN w USING (word) LEFT JOIN b USING (id) WHERE b.position IS NULL OR parent = b.position GROUP BY 1 HAVING count(DISTINCT pos) = 1),
p AS (SELECT d.doc_id AS id, coalesce(by_word, b.position) AS position, CASE WHEN by_word IS NOT NULL AND b.id IS NOT NULL THEN 0.9 WHEN by_word IS NOT NULL THEN 0.5 WHEN b.id IS NULL THEN NULL WHEN direct THEN 1.0 ELSE 0.9 END AS confidence,
 CASE WHEN by_word IS NOT NULL THEN 'keyword' WHEN b.id IS NULL THEN NULL WHEN NOT direct THEN 'inherited' WHEN kind = 0 THEN 'override' ELSE 'alias' END AS method FROM documents d LEFT JOIN b ON b.id = d.doc_id LEFT JOIN k ON k.id = d.doc_id)"""


def placements(t):
    tag = F.split(X.tag_words(F.col("text")), " ")
    items = t.documents.select(F.col("doc_id").alias("id"), F.array("source", "lang", F.concat_ws("/", "source", "lang")).alias("headings"), tag.alias("tag"))
    table = lambda rows, names: t.spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names))
    return K.placed(items, table(OVERRIDES, ("heading", "position")), table(ALIASES, ("heading", "position")), table(KEYWORDS, ("word", "position", "parent")))


@query("C3_placement", f"WITH {PLACED} SELECT * FROM p")
def placement(t):
    return placements(t)


@query("P5_needs_review", f"WITH {PLACED} SELECT id FROM p WHERE position IS NULL OR confidence < 0.95")
def needs_review(t):
    return placements(t).filter(K.needs_review(F.col("position"), F.col("confidence"), 0.95)).select("id")


@query("C4_refinement", "WITH d AS (SELECT doc_id AS id, lang, list_distinct(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' ')) AS w FROM documents) SELECT id, CASE WHEN lang = 'en' AND list_contains(w, 'the') AND list_contains(w, 'of') THEN 'en' WHEN lang = 'en' AND list_contains(w, 'the') THEN CASE WHEN list_contains(w, 'and') THEN 'en-the-and' ELSE 'en-the' END WHEN lang = 'en' AND list_contains(w, 'of') THEN 'en-of' ELSE lang END AS position FROM d")
def refinement(t):
    w = F.array_distinct(F.split(X.tag_words(F.col("text")), " "))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("position"), w.alias("words"))
    tree = t.spark.createDataFrame([("en", "en-the", "the"), ("en", "en-of", "of"), ("en-the", "en-the-and", "and")], "parent string, child string, word string")
    return K.refined(rows, tree, 2).select("id", "position")


@query("C5_own_side_role", f"WITH {EV} SELECT event_id, CASE WHEN position IN ('view', 'click') AND side = 'aff' THEN 'READS' WHEN position = 'error' THEN 'ANSWERS' WHEN side = 'neg' THEN 'READS' ELSE 'ANSWERS' END AS role FROM ev")
def own_side_role(t):
    p, aff = F.col("position"), F.col("side") == "aff"
    role = K.first_match((p.isin("view", "click") & aff, "READS"), (p == "error", "ANSWERS"), (~aff, "READS"), other="ANSWERS")
    return readings(t.events).select("event_id", role.alias("role"))


@query("C6_scrubbed_tags", f"SELECT item_id, array_to_string(list_filter(string_split({TAG}, ' '), lambda x: x NOT IN ('the', 'of', 'osmenteosmente')), ' ') AS tag FROM benchmark")
def scrubbed_tags(t):
    w = F.split(X.tag_words(F.col("text")), " ")
    return t.benchmark.select("item_id", F.array_join(F.filter(w, lambda x: ~x.isin("the", "of", "osmenteosmente")), " ").alias("tag"))


@query("C7_impact_labels", f"WITH g AS (SELECT doc_id, ' ' || {TAG} || ' ' AS tag FROM documents) SELECT doc_id, contains(tag, ' war ') OR contains(tag, ' the and ') OR contains(tag, ' of the ') AS impact FROM g")
def impact_labels(t):
    tag = X.tag_words(F.col("text"))
    return t.documents.select("doc_id", (K.whole_word(tag, "war") | K.whole_word(tag, "the and") | K.whole_word(tag, "of the")).alias("impact"))


@query("C8_link_roles", f"WITH g AS (SELECT item_id, ' ' || {TAG} || ' ' AS tag FROM benchmark) SELECT item_id, concat_ws(',', CASE WHEN contains(tag, ' the ') THEN 'link' END, CASE WHEN contains(tag, ' in ') THEN 'internal' END, CASE WHEN contains(tag, ' of ') THEN 'impact' END) AS roles FROM g")
def link_roles(t):
    tag = X.tag_words(F.col("text"))
    parts = [F.when(K.whole_word(tag, w), role) for w, role in (("the", "link"), ("in", "internal"), ("of", "impact"))]
    return t.benchmark.select("item_id", F.concat_ws(",", *parts).alias("roles"))


@query("C9_plan_verdicts", "WITH f AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_type <> 'view'), CAST([] AS VARCHAR[])) AS a, count(*) AS c FROM events GROUP BY 1), n AS (SELECT *, list_sort(list_filter(a, lambda x: NOT (x = 'click' AND (list_contains(a, 'purchase') OR list_contains(a, 'signup'))))) AS named FROM f) SELECT user_id, CASE WHEN c < 3 THEN 'UNREAD' WHEN len(named) = 0 THEN 'NONE' WHEN len(named) = 1 THEN 'NAMES' ELSE 'CONFLICTING' END AS verdict, CASE WHEN c >= 3 AND len(named) = 1 THEN named[1] END AS name FROM n")
def plan_verdicts(t):
    """What a user's events name; a kind that stands above another one (a click above a purchase) gives way to it."""
    named = A.narrowest(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type"))), {"purchase": ["click"], "signup": ["click"]})
    s = t.events.groupBy("user_id").agg(F.count("*").alias("c"), named.alias("named"))
    verdict = K.first_match((F.col("c") < 3, "UNREAD"), (F.size("named") == 0, "NONE"), (F.size("named") == 1, "NAMES"), other="CONFLICTING")
    return s.select("user_id", verdict.alias("verdict"), F.when((F.col("c") >= 3) & (F.size("named") == 1), F.get("named", F.lit(0))).alias("name"))


def narrow_sql(names: str) -> str:
    return f"list_sort(list_filter({names}, lambda x: NOT (x = 'D1' AND list_contains({names}, 'D2'))))"


NONE_SQL = "CAST([] AS VARCHAR[])"
CASCADE_SQL = f"""WITH d AS (SELECT l_orderkey AS round, nullif(o_custkey, 7) AS team, 'D' || CAST(round(l_discount * 100) AS INTEGER) AS mode, CASE l_quantity WHEN 50 THEN 'NAMES' WHEN 49 THEN CASE WHEN l_linenumber = 1 THEN 'CONFLICTING' ELSE 'NONE' END WHEN 48 THEN 'UNREAD' ELSE 'NONE' END AS v,
 l_quantity = 1 AND l_linenumber <= 2 AS marker, CASE WHEN l_quantity = 3 THEN 'NAMES' WHEN l_quantity = 4 AND l_linenumber = 1 THEN 'CONFLICTING' ELSE 'NONE' END AS tv, l_quantity = 47 AND l_linenumber = 3 AS put, l_quantity = 2 AS adv FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT round, max(team) AS team, coalesce(list(DISTINCT mode) FILTER (v = 'NAMES'), {NONE_SQL}) AS n0, bool_or(v = 'CONFLICTING') AS c0, bool_and(v = 'NONE') AS no_plan, bool_or(marker) AS marked, coalesce(list(DISTINCT mode) FILTER (tv = 'NAMES'), {NONE_SQL}) AS t0, bool_or(tv = 'CONFLICTING') AS tc0, bool_and(tv = 'NONE') AS t_none, coalesce(list(DISTINCT mode) FILTER (put), {NONE_SQL}) AS placed, bool_or(adv) AS advantage FROM d GROUP BY 1),
g AS (SELECT *, {narrow_sql('n0')} AS named, {narrow_sql('t0')} AS moved FROM f), h AS (SELECT *, c0 OR len(named) > 1 AS clash, tc0 OR len(moved) > 1 AS t_clash FROM g),
p1 AS (SELECT *, CASE WHEN NOT clash THEN named[1] END AS own FROM h),
m1 AS (SELECT team, coalesce(list(DISTINCT x) FILTER (x IS NOT NULL), {NONE_SQL}) AS a FROM (SELECT team, own AS x FROM p1 UNION ALL SELECT team, unnest(placed) FROM p1) GROUP BY 1), m2 AS (SELECT team, {narrow_sql('a')} AS a FROM m1),
k1 AS (SELECT team, bool_or(clash) AS c FROM p1 GROUP BY 1), tm AS (SELECT team, c OR len(a) > 1 AS disagrees, CASE WHEN NOT c AND len(a) = 1 THEN a[1] END AS carries FROM m2 JOIN k1 USING (team)),
p2 AS (SELECT p1.*, coalesce(disagrees, false) AS disagrees, own IS NULL AND len(placed) = 0 AND NOT clash AS free, CASE WHEN own IS NULL AND len(placed) = 0 AND NOT clash AND no_plan THEN carries END AS carried FROM p1 LEFT JOIN tm USING (team)),
p3 AS (SELECT *, free AND carried IS NULL AS open, free AND carried IS NULL AND no_plan AND marked AS by_marker FROM p2),
p4 AS (SELECT *, open AND NOT by_marker AND no_plan AND NOT disagrees AND NOT advantage AND len(moved) = 0 AND coalesce(team IN (SELECT team FROM p3 WHERE by_marker AND team IS NOT NULL), false) AS by_k FROM p3),
p5 AS (SELECT *, open AND NOT by_marker AND NOT by_k AS still, open AND NOT by_marker AND NOT by_k AND no_plan AND t_clash AS t_split, CASE WHEN open AND NOT by_marker AND NOT by_k AND no_plan AND NOT t_clash THEN moved[1] END AS t_own FROM p4),
n1 AS (SELECT team, coalesce(list(DISTINCT x) FILTER (x IS NOT NULL), {NONE_SQL}) AS a FROM (SELECT team, coalesce(own, carried, CASE WHEN by_marker OR by_k THEN 'D9' END, t_own) AS x FROM p5 UNION ALL SELECT team, unnest(placed) FROM p5) GROUP BY 1), n2 AS (SELECT team, {narrow_sql('a')} AS a FROM n1),
n3 AS (SELECT team, bool_or(t_own IS NOT NULL) AS reads, bool_or(disagrees OR t_split) AS apart FROM p5 GROUP BY 1), tn AS (SELECT team, CASE WHEN reads AND NOT apart AND len(a) = 1 THEN a[1] END AS t_carries FROM n2 JOIN n3 USING (team)),
p6 AS (SELECT p5.*, CASE WHEN still AND t_own IS NULL AND NOT t_split AND no_plan AND t_none THEN t_carries END AS t_carried FROM p5 LEFT JOIN tn USING (team))
SELECT round, coalesce(own, carried, CASE WHEN by_marker OR by_k THEN 'D9' END, t_own, t_carried) AS aff, CASE WHEN own IS NOT NULL THEN 'PLAN_TEXT' WHEN carried IS NOT NULL THEN 'TEAM_CARRY' WHEN by_marker THEN 'KRITIKAL_AFF_MARKER' WHEN by_k THEN 'KRITIKAL_AFF_CARRY' WHEN t_own IS NOT NULL THEN 'TRANSITION_PLAN_TEXT' WHEN t_carried IS NOT NULL THEN 'TRANSITION_PLAN_CARRY' END AS method FROM p6"""


@query("C10_assignment_cascade", CASCADE_SQL)
def assignment_cascade(t):
    """Orders as rounds of customers, lines as their documents; quantities stand for what a document's plan texts say, discounts for the aff."""
    q, line, aff = F.col("l_quantity"), F.col("l_linenumber"), F.concat(F.lit("D"), F.round(F.col("l_discount") * 100).cast("int").cast("string"))
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("round"), F.nullif("o_custkey", F.lit(7)).alias("team"), aff.alias("aff"), aff.alias("t_aff"),
        F.when(q == 50, "NAMES").when((q == 49) & (line == 1), "CONFLICTING").when(q == 48, "UNREAD").otherwise("NONE").alias("verdict"), ((q == 1) & (line <= 2)).alias("marker"),
        F.when(q == 3, "NAMES").when((q == 4) & (line == 1), "CONFLICTING").otherwise("NONE").alias("t_verdict"), ((q == 47) & (line == 3)).alias("put"), (q == 2).alias("adv"),
    )
    d = settled(d)
    return A.assigned(d, d.filter("put").select("round", "aff"), d.filter("adv").select("round"), "D9", {"D2": ["D1"]})


@query("C11_marker_families", f"WITH h AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z]+', ' ', 'g')) || ' ' AS w FROM part) SELECT p_partkey, CASE WHEN contains(w, ' standard ') THEN 'standard' WHEN contains(w, ' economy ') THEN 'economy' WHEN contains(w, ' part ') THEN 'part' END AS family FROM h")
def marker_families(t):
    w = X.tag_words(F.concat_ws(" ", "p_name", "p_type"))
    phrases = sorted(("part", "economy", "standard"), key=lambda p: (-len(p), p))  # the longest phrase first
    return t.part.select("p_partkey", K.first_match(*((K.whole_word(w, p), p) for p in phrases)).alias("family"))


@query("C12_leader_clusters")
def leader_clusters(t):
    """Word sets of the benchmark's items, each under the first larger one that is like it."""
    return M.leader_clusters(t.benchmark.select(F.col("item_id").alias("id"), F.array_sort(F.array_distinct(X.words(F.coalesce("text", F.lit(""))))).alias("items")))


@query("C13_answer_problems", "SELECT conv_id, turn, concat_ws(';', CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(text) > 400 THEN 'long' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN text = lag(text) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'echo' END) AS problems FROM conversations")
def answer_problems(t):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    parts = [F.when(F.length(F.trim("text")) == 0, "empty"), F.when(F.length("text") > 400, "long"), F.when(~F.col("role").isin("user", "assistant"), "role"), F.when(F.col("text") == before, "echo")]
    return t.conversations.select("conv_id", "turn", F.concat_ws(";", *parts).alias("problems"))


#: words that toxic documents share and no other labelled one has, found in the labels themselves
NAMES = """w AS (SELECT DISTINCT d.doc_id, toxic, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY 1) l ON l.doc_id = d.doc_id),
names AS (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 3 AND min(toxic) = 1)"""


def telling_names(t):
    """Words of three toxic documents at least that no labelled document without toxicity has."""
    known = t.labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("word")).join(known, "doc_id")
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("toxic").alias("least")).filter("n >= 3 and least = 1").select("word")


@query("C14_name_scan", f"WITH {NAMES}, l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) SELECT CASE WHEN l.word = upper(l.word) THEN 'code' WHEN l.word = lower(l.word) THEN 'list' ELSE 'name' END AS kind, names.word AS key, count(*) AS hits, count(DISTINCT doc_id) AS files FROM l JOIN names ON names.word = lower(l.word) GROUP BY 1, 2")
def name_scan(t):
    """Where the telling names stand in all documents, by their spelling."""
    hits = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("spelled")).withColumn("word", F.lower("spelled")).join(telling_names(t), "word")
    kind = K.first_match((F.col("spelled") == F.upper("spelled"), "code"), (F.col("spelled") == F.col("word"), "list"), other="name")
    return hits.groupBy(kind.alias("kind"), F.col("word").alias("key")).agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("files"))


@query("A23_hits_by_section", f"WITH {NAMES}, l AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT lang, word AS hit, count(*) AS hits, count(*) FILTER (doc_id % 2 = 0) AS accepted, count(*) FILTER (doc_id % 2 = 1) AS fresh FROM l JOIN names USING (word) GROUP BY 1, 2")
def hits_by_section(t):
    hits = t.documents.select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).join(telling_names(t), "word")
    return hits.groupBy("lang", F.col("word").alias("hit")).agg(F.count("*").alias("hits"), F.count_if(F.col("doc_id") % 2 == 0).alias("accepted"), F.count_if(F.col("doc_id") % 2 == 1).alias("fresh"))


@query("C15_suggested_ids", f"SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', ' ', 'g')), ' '), lambda x: length(x) > 2)[1:3], '-') AS suggested FROM part")
def suggested_ids(t):
    w = F.filter(F.split(X.tag_words(F.concat_ws(" ", "p_name", "p_brand")), " "), lambda x: F.length(x) > 2)
    return t.part.select("p_partkey", F.array_join(F.slice(w, 1, 3), "-").alias("suggested"))


@query("C16_decisions_applied", "WITH c AS (SELECT doc_id, quality FROM labels WHERE doc_id % 4 <> 0), d AS (SELECT doc_id, max(toxic) AS quality FROM labels WHERE doc_id % 3 = 0 GROUP BY 1), cc AS (SELECT doc_id, max(quality) AS quality FROM c GROUP BY 1) SELECT coalesce(cc.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN d.quality ELSE cc.quality END AS quality, CASE WHEN d.doc_id IS NULL THEN 'kept' WHEN cc.doc_id IS NULL THEN 'add' WHEN d.quality = cc.quality THEN 'unchanged' ELSE 'change' END AS action FROM cc FULL JOIN d ON cc.doc_id = d.doc_id")
def decisions_applied(t):
    current = t.labels.filter("doc_id % 4 <> 0").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    decisions = t.labels.filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.max("toxic").alias("quality"))
    return K.upsert_actions(current, decisions, "doc_id", "quality")


@query("C17_release_findings", "WITH r AS (SELECT p_partkey, p_brand, p_size FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'moved' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 10 <> 0) SELECT r.p_partkey, 'vanished' AS finding FROM r ANTI JOIN n USING (p_partkey) UNION ALL SELECT r.p_partkey, 'p_brand changed' FROM r JOIN n USING (p_partkey) WHERE r.p_brand <> n.p_brand")
def release_findings(t):
    now = t.part.filter("p_partkey % 10 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 9 == 0, "moved").otherwise(F.col("p_brand")))
    return K.release_findings(t.part, now, "p_partkey", ["p_brand", "p_size"])


@query("C18_staleness", "SELECT user_id, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01') AS age, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01') > 8 OR count(*) FILTER (value > 190) > 0 OR max_by(event_type, (ts, event_id)) = 'error' AS stale FROM events GROUP BY 1")
def staleness(t):
    age = F.date_diff(F.lit("2024-02-01").cast("date"), F.max(F.to_date("ts")))
    stale = (age > 8) | (F.count_if(F.col("value") > 190) > 0) | (F.max_by("event_type", F.struct("ts", "event_id")) == "error")
    return t.events.groupBy("user_id").agg(age.alias("age"), stale.alias("stale"))


@query("C19_retention", "WITH v AS (SELECT s_nationkey AS place, s_suppkey AS version, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS draft FROM supplier) SELECT place, version, CASE WHEN draft = 1 THEN 'not yet' WHEN r = 1 THEN 'current' WHEN r = 2 THEN 'previous' ELSE 'superseded' END AS state FROM v")
def retention(t):
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_suppkey")))
    v = t.supplier.select(F.col("s_nationkey").alias("place"), F.col("s_suppkey").alias("version"), r.alias("r"), (F.col("s_acctbal") < 0).alias("draft"))
    return v.select("place", "version", K.first_match((F.col("draft"), "not yet"), (F.col("r") == 1, "current"), (F.col("r") == 2, "previous"), other="superseded").alias("state"))


@query("C20_quality_checks", "WITH c AS (SELECT source, CASE WHEN n_chars = 0 THEN 'FAIL' WHEN n_chars < 100 THEN 'WARN' ELSE 'PASS' END AS s FROM documents) SELECT source, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (s <> 'PASS') AS findings FROM c GROUP BY 1")
def quality_checks(t):
    s = F.when(F.col("n_chars") == 0, "FAIL").when(F.col("n_chars") < 100, "WARN").otherwise("PASS")
    return t.documents.groupBy("source").agg(K.worst(s).alias("status"), F.count_if(s != "PASS").alias("findings"))


@query("P1_filter_before_scale", "WITH d AS (SELECT * FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, round(n_chars * 1.0 / (SELECT max(n_chars) FROM d), 6) AS scaled FROM d")
def filter_before_scale(t):
    d = t.documents.filter(F.col("lang").isin("en", "fr"))
    return d.crossJoin(F.broadcast(d.agg(F.max("n_chars").alias("top")))).select("doc_id", F.round(F.col("n_chars") / F.col("top"), 6).alias("scaled"))  # one row


@query("P2_optional_filters", "SELECT o_orderkey FROM orders WHERE (NULL IS NULL OR o_orderstatus = NULL) AND ('1-URGENT' IS NULL OR o_orderpriority = '1-URGENT') AND o_orderdate >= DATE '1995-01-01'")
def optional_filters(t):
    wanted = {"o_orderstatus": None, "o_orderpriority": "1-URGENT"}
    rows = t.orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("date"))
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.select("o_orderkey")


@query("P6_team_floor", f"WITH {EV}, g AS (SELECT position, round, count(DISTINCT team) AS teams FROM ev GROUP BY 1, 2) SELECT position, count(*) FILTER (teams >= 2) AS shown, count(*) FILTER (teams < 2) AS withheld FROM g GROUP BY 1")
def team_floor(t):
    g = readings(t.events).groupBy("position", "round").agg(F.count_distinct("team").alias("teams"))
    return g.groupBy("position").agg(F.count_if(F.col("teams") >= 2).alias("shown"), F.count_if(F.col("teams") < 2).alias("withheld"))


@query("P7_long_bodies", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 1000")
def long_bodies(t):
    return t.documents.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 1000).select("doc_id")


@query("P8_line_forms", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (length(line) <= 60 AND regexp_matches(line, '^[A-Z ]+$')) AS headings, count(*) FILTER (length(line) <= 60 AND regexp_matches(line, '^[0-9]+[.)]')) AS numbered FROM l GROUP BY 1")
def line_forms(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    short = F.length("line") <= 60
    return lines.groupBy("doc_id").agg(F.count_if(short & F.col("line").rlike("^[A-Z ]+$")).alias("headings"), F.count_if(short & F.col("line").rlike("^[0-9]+[.)]")).alias("numbered"))


@query("P11_keyword_containment", f"SELECT item_id FROM benchmark WHERE contains(' ' || {TAG} || ' ', ' the ') OR contains(' ' || {TAG} || ' ', ' del ')")
def keyword_containment(t):
    tag = X.tag_words(F.col("text"))
    return t.benchmark.filter(K.whole_word(tag, "the") | K.whole_word(tag, "del")).select("item_id")


@query("P12_feed_terms", "SELECT page_id FROM pages WHERE regexp_matches(lower(html), '(^|[^0-9a-z])the([^0-9a-z]|$)') AND regexp_matches(lower(html), '(^|[^0-9a-z])of([^0-9a-z]|$)')")
def feed_terms(t):
    whole = lambda w: F.lower("html").rlike(f"(^|[^0-9a-z]){w}([^0-9a-z]|$)")
    return t.pages.filter(whole("the") & whole("of")).select("page_id")


@query("P13_date_window", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts END AS ts FROM events) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def date_window(t):
    ts = F.when(F.col("event_id") % 6 != 0, F.col("ts"))
    return t.events.filter(ts.between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")


@query("P14_no_card", "SELECT doc_id FROM documents WHERE NOT (n_chars < 30 OR (source = 'src0' AND len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) < 25))")
def no_card(t):
    few = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) < 25
    return t.documents.filter(~((F.col("n_chars") < 30) | ((F.col("source") == "src0") & few))).select("doc_id")

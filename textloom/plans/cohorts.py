"""Queries of the aggregation and window families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import cohorts as C
from textloom.plans.registry import Tables, query

EV = """ev AS (SELECT event_id, user_id AS team, event_type AS position, CASE WHEN user_id % 2 = 0 THEN 'aff' ELSE 'neg' END AS side,
  CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS DATE) AS snapshot, CAST(ts AS DATE) AS day,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS round, value, ts FROM events)"""
#: calls of an invented model: every seventh has no price, every fifth no token count
CALLS = "calls AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS cost, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round END AS tokens FROM ev)"


def calls(t: Tables):
    return C.readings(t.events).withColumns({"cost": F.when(F.col("event_id") % 7 != 0, F.col("value")), "tokens": F.when(F.col("event_id") % 5 != 0, F.col("round"))})


@query("A1_usage_summary", f"WITH {EV}, {CALLS} SELECT position, side, count(*) AS calls, sum(coalesce(tokens, 0)) AS tokens, round(coalesce(sum(cost), 0.0), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced_calls FROM calls GROUP BY 1, 2")
def usage(t):
    return C.usage_summary(calls(t), "position", "side")


@query("A2_zoned_month_totals", "SELECT strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m') AS month, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1")
def zoned_months(t):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Chicago")
    return t.events.groupBy(F.date_format(local, "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("A3_teams_by_side", f"WITH {EV} SELECT snapshot, count(DISTINCT CASE WHEN side = 'aff' THEN team END) AS aff_teams, count(DISTINCT CASE WHEN side = 'neg' THEN team END) AS neg_teams FROM ev GROUP BY 1")
def teams_by_side(t):
    r = C.readings(t.events)
    return r.groupBy("snapshot").agg(*(F.count_distinct(F.when(F.col("side") == s, F.col("team"))).alias(f"{s}_teams") for s in ("aff", "neg")))


@query("A4_teams_reading", f"WITH {EV} SELECT snapshot, position, count(DISTINCT team) AS both_sides, count(DISTINCT CASE WHEN side = 'aff' THEN team END) AS aff_only FROM ev GROUP BY 1, 2")
def teams_reading(t):
    return C.readings(t.events).groupBy("snapshot", "position").agg(F.count_distinct("team").alias("both_sides"), F.count_distinct(F.when(F.col("side") == "aff", F.col("team"))).alias("aff_only"))


SHARES = f"""WITH {EV}, d AS (SELECT snapshot, count(DISTINCT team) AS disclosing FROM ev GROUP BY 1),
s AS (SELECT snapshot, position, count(DISTINCT team) AS teams FROM ev GROUP BY 1, 2)"""


@query("A5_exact_shares", SHARES + " SELECT snapshot, position, teams, disclosing, round(100.0 * teams / nullif(disclosing, 0), 6) AS points FROM s JOIN d USING (snapshot)")
def exact_shares(t):
    return C.weekly_shares(C.readings(t.events)).select("snapshot", "position", "teams", "disclosing", F.round(F.lit(100.0) * F.col("teams") / F.nullif("disclosing", F.lit(0)), 6).alias("points"))


@query("A6_trend_labels", SHARES + """, w AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS previous FROM d),
f AS (SELECT position, min(snapshot) AS first_seen FROM ev GROUP BY 1),
r AS (SELECT s.snapshot, s.position, s.teams, d.disclosing, w.previous, f.first_seen, CASE WHEN w.previous IS NOT NULL THEN coalesce(p.teams, 0) END AS previous_teams, pd.disclosing AS previous_disclosing
  FROM s JOIN d USING (snapshot) JOIN w USING (snapshot) JOIN f USING (position) LEFT JOIN s p ON p.snapshot = w.previous AND p.position = s.position LEFT JOIN d pd ON pd.snapshot = w.previous),
g AS (SELECT *, teams * previous_disclosing - previous_teams * disclosing AS gap, greatest(teams, previous_teams) < 3 AS few FROM r)
SELECT snapshot, position, teams, disclosing, previous_teams, previous_disclosing,
 CASE WHEN previous IS NULL OR first_seen = snapshot THEN 'NEW' WHEN gap IS NULL OR abs(gap) * 100 < 5 * disclosing * previous_disclosing OR few THEN 'STEADY' WHEN gap > 0 THEN 'RISING' ELSE 'FALLING' END AS trend,
 coalesce(previous IS NOT NULL AND first_seen < snapshot AND abs(gap) * 100 >= 5 * disclosing * previous_disclosing AND few, false) AS held_back FROM g""")
def trends(t):
    return C.trend_labels(C.readings(t.events))


@query("A7_round_ids", "SELECT event_id, substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), lower(event_type), coalesce(json_extract_string(props, '$.k'), CAST(event_id AS VARCHAR)))), 1, 16) AS round_id FROM events")
def round_ids(t):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.col("event_id").cast("string"))
    return t.events.select("event_id", F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.lower("event_type"), k), 256), 1, 16).alias("round_id"))


@query("A8_first_last_seen", f"WITH {EV} SELECT team, min(snapshot) AS first_seen, max(snapshot) AS last_seen FROM ev GROUP BY 1")
def first_last(t):
    return C.readings(t.events).groupBy("team").agg(F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"))


@query("A9_first_seen_counts", f"WITH {EV}, f AS (SELECT round, min(snapshot) AS snapshot FROM ev GROUP BY 1) SELECT snapshot, count(*) AS first_seen_count FROM f GROUP BY 1")
def first_seen_counts(t):
    f = C.readings(t.events).groupBy("round").agg(F.min("snapshot").alias("snapshot"))
    return f.groupBy("snapshot").agg(F.count("*").alias("first_seen_count"))


@query("A10_heading_seeds", f"""WITH {EV}, m AS (SELECT position, round % 4 AS level, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT position, count(*) AS documents, count(DISTINCT team) AS teams, count(DISTINCT CASE WHEN side = 'aff' THEN team END) AS aff_teams, count(DISTINCT CASE WHEN side = 'neg' THEN team END) AS neg_teams,
 (SELECT level FROM m WHERE m.position = ev.position ORDER BY n DESC, level LIMIT 1) AS level FROM ev GROUP BY position""")
def heading_seeds(t):
    r = C.readings(t.events)
    levels = r.groupBy("position", (F.col("round") % 4).alias("level")).agg(F.count("*").alias("n")).groupBy("position").agg(F.min_by("level", F.struct(-F.col("n"), "level")).alias("level"))
    side = lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("team"))).alias(f"{s}_teams")
    return r.groupBy("position").agg(F.count("*").alias("documents"), F.count_distinct("team").alias("teams"), side("aff"), side("neg")).join(levels, "position")


@query("A11_review_rows", f"""WITH {EV}, c AS (SELECT position, team, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, team) AS place FROM c)
SELECT position, count(*) AS teams, sum(n) AS cards, string_agg(CASE WHEN place <= 3 THEN CAST(team AS VARCHAR) END, ',' ORDER BY place) AS candidates FROM r GROUP BY 1""")
def review_rows(t):
    c = C.readings(t.events).groupBy("position", "team").agg(F.count("*").alias("n"))
    r = c.withColumn("place", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("n"), "team")))
    top = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "team"))))
    return r.groupBy("position").agg(F.count("*").alias("teams"), F.sum("n").alias("cards"), F.array_join(F.transform(top, lambda x: x["team"].cast("string")), ",").alias("candidates"))


@query("A12_row_scores", f"""WITH {EV}, s AS (SELECT team, position, sum(value) AS total FROM ev GROUP BY 1, 2), n AS (SELECT team, count(*) AS cards FROM ev GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(total, 6) DESC, position) AS place FROM s) SELECT team, position AS suggestion, round(total / cards, 6) AS score FROM b JOIN n USING (team) WHERE place = 1""")
def row_scores(t):
    r = C.readings(t.events)
    s = r.groupBy("team", "position").agg(F.sum("value").alias("total"), F.count("*").alias("some"))
    best = s.groupBy("team").agg(F.min_by(F.struct("position", "total"), F.struct(-F.round("total", 6), "position")).alias("b"), F.sum("some").alias("cards"))
    return best.select("team", F.col("b.position").alias("suggestion"), F.round(F.col("b.total") / F.col("cards"), 6).alias("score"))


@query("A13_team_rounds", f"WITH {EV} SELECT team, side, position, count(DISTINCT round) AS rounds FROM ev GROUP BY 1, 2, 3")
def team_rounds(t):
    return C.readings(t.events).groupBy("team", "side", "position").agg(F.count_distinct("round").alias("rounds"))


@query("A14_usual_spelling", "WITH s AS (SELECT lang, source AS spelling, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, spelling) AS p FROM s) SELECT lang, spelling, n FROM r WHERE p = 1")
def usual_spelling(t):
    s = t.documents.groupBy("lang", F.col("source").alias("spelling")).agg(F.count("*").alias("n"))
    return s.groupBy("lang").agg(F.min_by(F.struct("spelling", "n"), F.struct(-F.col("n"), "spelling")).alias("b")).select("lang", "b.spelling", "b.n")


@query("A15_ancestor_rollup", """WITH b AS (SELECT n_nationkey, n_name, r_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey),
e AS (SELECT 'nation' AS level, n_name AS name, c_custkey, o_orderkey FROM b UNION ALL SELECT 'region', r_name, c_custkey, o_orderkey FROM b),
g AS (SELECT level, name, count(DISTINCT c_custkey) AS teams, count(DISTINCT o_orderkey) AS rounds FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY teams DESC, name) AS place FROM g) SELECT * FROM r WHERE place <= 5""")
def ancestor_rollup(t):
    b = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    line = F.explode(F.array(F.struct(F.lit("nation").alias("level"), F.col("n_name").alias("name")), F.struct(F.lit("region").alias("level"), F.col("r_name").alias("name")))).alias("a")
    g = b.select(line, "c_custkey", "o_orderkey").groupBy("a.level", "a.name").agg(F.count_distinct("c_custkey").alias("teams"), F.count_distinct("o_orderkey").alias("rounds"))
    return C.top_per_group(g, ["level"], [F.desc("teams"), F.asc("name")], 5).drop("more")


@query("A16_group_counts", f"WITH {EV} SELECT position, count(DISTINCT team) FILTER (round % 2 = 0) AS kritikal_teams, count(DISTINCT team) FILTER (round % 2 = 1) AS policy_teams, count(*) FILTER (round IS NULL) AS unread FROM ev GROUP BY 1")
def group_counts(t):
    even = F.col("round") % 2
    return C.readings(t.events).groupBy("position").agg(F.count_distinct(F.when(even == 0, F.col("team"))).alias("kritikal_teams"), F.count_distinct(F.when(even == 1, F.col("team"))).alias("policy_teams"), F.count_if(F.col("round").isNull()).alias("unread"))


@query("A17_late_word_classes", """WITH c AS (SELECT doc_id % 5 = 0 AS late, CASE WHEN text IS NULL THEN 'not parsed' WHEN contains(lower(text), ' the ') AND contains(lower(text), ' de ') THEN 'both' WHEN contains(lower(text), ' the ') THEN 'this' WHEN contains(lower(text), ' de ') THEN 'other' ELSE 'neither' END AS word_class FROM documents)
SELECT late, word_class, count(*) AS n FROM c GROUP BY 1, 2""")
def late_word_classes(t):
    low = F.lower("text")
    this, other = low.contains(" the "), low.contains(" de ")
    kind = F.when(F.col("text").isNull(), "not parsed").when(this & other, "both").when(this, "this").when(other, "other").otherwise("neither")
    return t.documents.groupBy((F.col("doc_id") % 5 == 0).alias("late"), kind.alias("word_class")).agg(F.count("*").alias("n"))


@query("A18_bands", "SELECT CASE WHEN n_chars < 100 THEN 'under 100' WHEN n_chars < 1000 THEN '100-999' WHEN n_chars < 5000 THEN '1000-4999' ELSE '5000 and over' END AS band, count(*) AS n FROM documents GROUP BY 1")
def bands(t):
    n = F.col("n_chars")
    return t.documents.groupBy(F.when(n < 100, "under 100").when(n < 1000, "100-999").when(n < 5000, "1000-4999").otherwise("5000 and over").alias("band")).agg(F.count("*").alias("n"))


@query("A20_tallies", "SELECT count(*) AS bodies, count(*) FILTER (len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 3000) AS long_bodies, count(*) FILTER (contains(text, '|')) AS tables, count(*) FILTER (NOT regexp_matches(text, '[a-z]')) AS no_lower FROM documents")
def tallies(t):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return t.documents.agg(F.count("*").alias("bodies"), F.count_if(words > 3000).alias("long_bodies"), F.count_if(F.col("text").contains("|")).alias("tables"), F.count_if(~F.col("text").rlike("[a-z]")).alias("no_lower"))


@query("A22_surviving_counts", "SELECT l_orderkey, count(DISTINCT l_partkey) AS files, CASE WHEN bool_and(l_returnflag <> 'N') THEN count(DISTINCT l_suppkey) END AS teams FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1")
def surviving(t):
    stopped = t.supplier.filter("s_suppkey % 4 = 0")
    left = t.lineitem.join(stopped, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return left.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("files"), F.when(F.bool_and(F.col("l_returnflag") != "N"), F.count_distinct("l_suppkey")).alias("teams"))


@query("A24_season_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def season_totals(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("A25_set_digest", "SELECT source, sha256(string_agg(DISTINCT lang, ',' ORDER BY lang)) AS digest, count(DISTINCT lang) AS n FROM documents GROUP BY 1")
def set_digest(t):
    return t.documents.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("lang")), ","), 256).alias("digest"), F.count_distinct("lang").alias("n"))


@query("A26_search_status", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'COMPLETE' WHEN bool_or(event_type <> 'error') THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM events GROUP BY 1")
def search_status(t):
    ok = F.col("event_type") != "error"
    return t.events.groupBy("user_id").agg(F.when(F.bool_and(ok), "COMPLETE").when(F.bool_or(ok), "PARTIAL").otherwise("FAILED").alias("status"))


WORDS_SQL = "w AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS word FROM documents)"


@query("A27_frame_words", f"WITH {WORDS_SQL}, n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, word, count(*) AS texts FROM w JOIN n USING (lang) GROUP BY lang, word, n HAVING count(*) * 10 >= 8 * n")
def frame_words(t):
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " "), " "), lambda x: x != ""))
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    w = t.documents.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("texts"))
    return w.join(n, "lang").filter("texts * 10 >= 8 * n").drop("n")


@query("A28_shared_words", f"WITH {WORDS_SQL}, g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT d.source, w.word, count(*) AS c FROM w JOIN documents d USING (doc_id) GROUP BY 1, 2) SELECT source, string_agg(word, ' ' ORDER BY word) AS shared FROM s JOIN g USING (source) WHERE c * 2 > n GROUP BY 1")
def shared_words(t):
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " "), " "), lambda x: x != ""))
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    w = t.documents.select("source", F.explode(words).alias("word")).groupBy("source", "word").agg(F.count("*").alias("c"))
    return w.join(n, "source").filter("c * 2 > n").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("shared"))


@query("A29_method_counts", "SELECT coalesce(CASE WHEN quality = 1 AND toxic = 1 THEN 'model' WHEN quality = 1 THEN 'alias' END, 'UNPLACED') AS method, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1")
def method_counts(t):
    method = F.coalesce(F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "model").when(F.col("quality") == 1, "alias"), F.lit("UNPLACED"))
    g = t.labels.groupBy(method.alias("method")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a method


@query("A34_position_table", f"""WITH {EV}, k AS (SELECT count(DISTINCT CASE WHEN side = 'aff' THEN team END) AS all_aff, max(snapshot) AS last FROM ev)
SELECT position, count(DISTINCT (team, round)) AS rounds, count(DISTINCT team) AS teams, count(DISTINCT CASE WHEN side = 'aff' THEN (team, round) END) AS aff_rounds, count(DISTINCT CASE WHEN side = 'neg' THEN (team, round) END) AS neg_rounds,
 round(count(DISTINCT CASE WHEN side = 'aff' THEN team END) / nullif(any_value(all_aff), 0), 6) AS aff_share, min(snapshot) AS first_seen, min(snapshot) = any_value(last) AS is_new FROM ev, k GROUP BY 1""")
def position_table(t):
    return C.position_table(C.readings(t.events))


@query("A35_top_cards", f"WITH {EV}, g AS (SELECT position, round, count(DISTINCT team) AS teams FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY teams DESC, round) AS place, count(*) OVER (PARTITION BY position) AS n FROM g) SELECT position, round, teams, place, greatest(n - 5, 0) AS more FROM r WHERE place <= 5")
def top_cards(t):
    g = C.readings(t.events).groupBy("position", "round").agg(F.count_distinct("team").alias("teams"))
    return C.top_per_group(g, ["position"], [F.desc("teams"), F.asc("round")], 5)


@query("A36_representatives", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY CASE WHEN n_chars >= 1000 THEN 0 WHEN n_chars >= 200 THEN 1 ELSE 2 END, doc_id % 2, doc_id DESC) AS p FROM documents) SELECT source, lang, doc_id, n_chars FROM r WHERE p = 1")
def representatives(t):
    level = F.when(F.col("n_chars") >= 1000, 0).when(F.col("n_chars") >= 200, 1).otherwise(2)
    return t.documents.groupBy("source", "lang").agg(F.min_by(F.struct("doc_id", "n_chars"), F.struct(level, F.col("doc_id") % 2, -F.col("doc_id"))).alias("b")).select("source", "lang", "b.doc_id", "b.n_chars")


@query("A37_document_facts", f"WITH {EV}, g AS (SELECT position, round, count(*) AS occurrences, count(DISTINCT team) AS teams, string_agg(DISTINCT side, ',' ORDER BY side) AS sides, min(snapshot) AS first_seen, max(snapshot) AS last_seen FROM ev GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY position ORDER BY round) AS doc_no FROM g")
def document_facts(t):
    g = C.readings(t.events).groupBy("position", "round").agg(F.count("*").alias("occurrences"), F.count_distinct("team").alias("teams"), F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"), F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"))
    return g.withColumn("doc_no", F.row_number().over(Window.partitionBy("position").orderBy("round")))


@query("A38_coverage_line", "SELECT round(100.0 * count(*) FILTER (quality = 1) / count(*), 1) AS placed, round(100.0 * count(*) FILTER (toxic = 0) / count(*), 1) AS identified FROM labels")
def coverage_line(t):
    share = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 1)
    return t.labels.agg(share(F.col("quality") == 1).alias("placed"), share(F.col("toxic") == 0).alias("identified"))


@query("A39_texts_and_more", f"WITH {EV}, g AS (SELECT position, sha256(CAST(round AS VARCHAR)) AS digest, count(DISTINCT team) AS teams FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY teams DESC, digest) AS place FROM g) SELECT position, count(*) - 3 AS more, sum(teams) FILTER (place > 3) AS by_teams, max(digest) FILTER (place = 1) AS first_digest FROM r GROUP BY 1 HAVING count(*) > 3")
def texts_and_more(t):
    g = C.readings(t.events).groupBy("position", F.sha2(F.col("round").cast("string"), 256).alias("digest")).agg(F.count_distinct("team").alias("teams"))
    r = g.withColumn("place", F.row_number().over(Window.partitionBy("position").orderBy(F.desc("teams"), "digest")))
    out = r.groupBy("position").agg((F.count("*") - 3).alias("more"), F.sum(F.when(F.col("place") > 3, F.col("teams"))).alias("by_teams"), F.max(F.when(F.col("place") == 1, F.col("digest"))).alias("first_digest"))
    return out.filter("more > 0")


@query("A40_plank_groups", "WITH p AS (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS solves, p_name FROM part), g AS (SELECT coalesce(solves, 'not named') AS solves, p_brand, count(*) AS planks FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY solves ORDER BY planks DESC, p_brand) AS place FROM g) SELECT solves, p_brand, planks, place FROM r WHERE place <= 3")
def plank_groups(t):
    solves = F.coalesce(F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.lit("not named")).alias("solves")
    return C.top_per_group(t.part.groupBy(solves, "p_brand").agg(F.count("*").alias("planks")), ["solves"], [F.desc("planks"), F.asc("p_brand")], 3).drop("more")


@query("A41_overview_counts", f"WITH {EV} SELECT position, count(DISTINCT CASE WHEN side = 'aff' AND round % 3 = 0 THEN team END) AS aff_overviews, count(DISTINCT CASE WHEN side = 'neg' AND round % 3 = 0 THEN team END) AS neg_overviews FROM ev GROUP BY 1")
def overview_counts(t):
    third = F.col("round") % 3 == 0
    return C.readings(t.events).groupBy("position").agg(*(F.count_distinct(F.when((F.col("side") == s) & third, F.col("team"))).alias(f"{s}_overviews") for s in ("aff", "neg")))


@query("W3_weekly_lag", f"WITH {EV}, s AS (SELECT snapshot, position, count(DISTINCT team) AS teams FROM ev GROUP BY 1, 2) SELECT snapshot, position, teams, teams - lag(teams) OVER (PARTITION BY position ORDER BY snapshot) AS change FROM s")
def weekly_lag(t):
    s = C.readings(t.events).groupBy("snapshot", "position").agg(F.count_distinct("team").alias("teams"))
    return s.withColumn("change", F.col("teams") - F.lag("teams").over(Window.partitionBy("position").orderBy("snapshot")))


@query("W4_first_ever", f"WITH {EV}, s AS (SELECT DISTINCT snapshot, team, position FROM ev) SELECT *, min(snapshot) OVER (PARTITION BY team, position) = snapshot AS first_ever FROM s")
def first_ever(t):
    s = C.readings(t.events).select("snapshot", "team", "position").distinct()
    return s.withColumn("first_ever", F.min("snapshot").over(Window.partitionBy("team", "position")) == F.col("snapshot"))


@query("W6_newest_rounds", f"WITH {EV}, s AS (SELECT team, round, min(snapshot) AS first_seen FROM ev GROUP BY 1, 2) SELECT team, round, first_seen, row_number() OVER (PARTITION BY team ORDER BY first_seen DESC, CASE WHEN round >= 90 THEN 0 WHEN round >= 50 THEN 1 ELSE 2 END, round) AS place FROM s")
def newest_rounds(t):
    s = C.readings(t.events).groupBy("team", "round").agg(F.min("snapshot").alias("first_seen"))
    level = F.when(F.col("round") >= 90, 0).when(F.col("round") >= 50, 1).otherwise(2)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("first_seen"), level, "round")))


@query("W7_holdout_sample", """WITH s AS (SELECT doc_id, source, lang, sha256('seed|' || CAST(doc_id AS VARCHAR)) AS draw FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY draw) AS in_source FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw) AS place FROM o WHERE in_source = 1) SELECT lang, source, doc_id, place FROM r WHERE place <= 10""")
def holdout_sample(t):
    s = t.documents.select("doc_id", "source", "lang", F.sha2(F.concat(F.lit("seed|"), F.col("doc_id").cast("string")), 256).alias("draw"))
    one = s.groupBy("lang", "source").agg(F.min_by("doc_id", "draw").alias("doc_id"), F.min("draw").alias("draw"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter("place <= 10").drop("draw")


@query("W8_round_robin", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT event_id, user_id, turn, row_number() OVER (ORDER BY turn, user_id) AS place FROM r QUALIFY place <= 200")
def round_robin(t):
    r = t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"))
    first = r.orderBy("turn", "user_id").limit(200)  # a page of the merged list
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", "user_id")))


@query("W9_first_occurrence", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY team, round ORDER BY position, ts, event_id) AS p FROM ev) SELECT team, round, event_id, position FROM r WHERE p = 1")
def first_occurrence(t):
    best = F.min_by(F.struct("event_id", "position"), F.struct("position", "ts", "event_id")).alias("b")
    return C.readings(t.events).groupBy("team", "round").agg(best).select("team", "round", "b.event_id", "b.position")


@query("W11_latest_run", "SELECT user_id, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE event_type <> 'error' AND ts > (SELECT max(ts) - INTERVAL 24 HOUR FROM events) GROUP BY 1")
def latest_run(t):
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS"))  # one row
    return recent.filter("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("ts"))


@query("W12_running_budget", "WITH r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, round(sum(coalesce(value, 0.0)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events) SELECT *, spent <= 100.0 AS within FROM r")
def running_budget(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return C.running_budget(e, ["user_id", "day"], 100.0).select("event_id", "user_id", "day", "spent", "within")


@query("W13_burst", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_interval FROM events")
def burst(t):
    return C.burst_counts(t.events, "user_id", 3600).select("event_id", "user_id", "in_interval")

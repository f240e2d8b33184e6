"""Queries of the text-matching family."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.storage import settled
from textloom.operators import abbreviations as AB
from textloom.operators import matching as M
from textloom.plans.registry import query

#: the SQL forms of the matching normalisation; ASCII classes keep both engines alike
NORM = "trim(regexp_replace(lower(translate(text, '‘’‚‛′´`“”„‟″«»‐‑‒–—―−', '''''''''''''''\"\"\"\"\"\"\"-------')), '[\\s  ]+', ' ', 'g'))"
WORDS = f"regexp_extract_all(regexp_replace({NORM}, '([0-9a-z_])- ([0-9a-z_])', '\\1\\2', 'g'), '\\w+')"


def shingle_sql() -> str:
    runs = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))"
    return f"t AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS MATERIALIZED (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {runs} END AS sh FROM t)"


@query("N1_normalize", f"SELECT doc_id, md5({NORM}) AS form FROM documents")
def normalize(t):
    return t.documents.select("doc_id", F.md5(X.normalize_ascii(F.col("text"))).alias("form"))


@query("N1_normalize_unicode")
def normalize_unicode(t):
    return t.documents.select("doc_id", F.md5(X.normalize_for_matching("text")).alias("form"))


@query("N2_fingerprint", f"SELECT sha256({NORM}) AS fingerprint, count(*) AS copies, min(doc_id) AS cluster FROM documents GROUP BY 1")
def fingerprint(t):
    return t.documents.groupBy(X.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("cluster"))


@query("N3_card_fingerprint", f"SELECT doc_id, CASE WHEN n_chars < 200 THEN sha256('cite-line' || chr(0) || lower(source)) ELSE sha256({NORM}) END AS fingerprint FROM documents")
def card_fingerprint(t):
    level = F.when(F.col("n_chars") < 200, "CITE_ONLY").otherwise("FULL")
    return t.documents.select("doc_id", X.card_fingerprint(F.col("text"), F.col("source"), level).alias("fingerprint"))


@query("N4_cutter_mark", "WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' // AB' || chr(10) || '  ' WHEN item_id % 3 = 1 THEN text || ' http://x' ELSE text END AS body FROM benchmark), m AS (SELECT item_id, regexp_extract(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')[-1], '(^|[^:])//[ ]*([A-Za-z0-9]+)[ ]*$', 2) AS mark FROM b) SELECT item_id, CASE WHEN mark <> '' AND length(mark) <= 20 THEN mark END AS mark FROM m")
def cutter_mark(t):
    third = F.col("item_id") % 3
    body = F.when(third == 0, F.concat("text", F.lit(" // AB\n  "))).when(third == 1, F.concat("text", F.lit(" http://x"))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", X.cutter_mark(body).alias("mark"))


@query("N5_matching_words", f"SELECT doc_id, len({WORDS}) AS n, md5(array_to_string({WORDS}, ' ')) AS words FROM documents")
def matching_words(t):
    w = X.matching_words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("n"), F.md5(F.array_join(w, " ")).alias("words"))


@query("N6_shingles", f"WITH {shingle_sql()} SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), '|')) AS digest FROM s")
def shingles(t):
    s = M.bodies(t.documents, "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), F.size("shingles").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("shingles"), "|")).alias("digest"))


SIG = "list_transform(generate_series(0, 7), lambda i: list_min(list_transform(sh, lambda x: ('0x' || substr(md5(CAST(i AS VARCHAR) || '|' || x), 1, 8))::BIGINT)))"


@query("N7_minhash_md5", f"WITH {shingle_sql()} SELECT doc_id, array_to_string({SIG}, ',') AS signature FROM s WHERE len(sh) > 0")
def minhash_md5(t):
    s = M.bodies(t.documents, "doc_id", "text").filter(F.size("shingles") > 0)
    return s.select(F.col("id").alias("doc_id"), F.array_join(F.transform(M.signature_column(F.col("shingles"), 8), lambda x: x.cast("string")), ",").alias("signature"))


MINIMA = ", ".join(f"min((x * {a} + {b}) % {M.PRIME}) AS m{i}" for i, (a, b) in enumerate(M.linear_maps(M.BANDS * M.ROWS)))
BAND_SQL = f"""{shingle_sql()}, x AS (SELECT doc_id, ('0x' || substr(md5(unnest(sh)), 1, 8))::BIGINT // 2 AS x FROM s), g AS (SELECT doc_id, {MINIMA} FROM x GROUP BY 1),
k AS (SELECT doc_id, unnest([{", ".join("'" + str(b) + "|' || " + " || ',' || ".join(f"m{M.ROWS * b + r}" for r in range(M.ROWS)) for b in range(M.BANDS))}]) AS key FROM g),
l AS (SELECT key, min(doc_id) AS a FROM k GROUP BY 1), c AS (SELECT a, doc_id AS b, count(*) AS bands FROM k JOIN l USING (key) WHERE doc_id <> a GROUP BY 1, 2)"""


def band_members(t):
    """(a, b, bands): each document with the first document of each of its 32 bands of 4 minima, and in how many bands it meets it."""
    s = M.bodies(t.documents, "doc_id", "text")
    x = s.filter(F.size("shingles") > 0).select("id", F.transform("shingles", lambda g: F.unhex(F.substring(F.md5(g), 1, 8))).alias("x"))
    keyed = settled(x.select("id", F.explode(M.plain_bands("x")).alias("key")))
    lead = keyed.groupBy("key").agg(F.min("id").alias("a"))
    return keyed.join(lead, "key").filter("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("bands"))


@query("N8_band_candidates", f"WITH {BAND_SQL} SELECT a, b FROM c")
def band_candidates(t):
    return band_members(t).select("a", "b")


@query("J4_band_join", f"WITH {BAND_SQL} SELECT a, b, bands FROM c WHERE bands >= 2")
def band_join(t):
    return band_members(t).filter("bands >= 2")


COUNTED = "p AS (SELECT a, b, shared, x.n, y.n AS m FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)"


def near_sql() -> str:
    """Each document with the first holder of one of its shingles."""
    return f"""{shingle_sql()}, e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
l AS (SELECT g, min(doc_id) AS a FROM e GROUP BY 1), k AS (SELECT DISTINCT a, doc_id AS b FROM e JOIN l USING (g) WHERE doc_id <> a),
c AS (SELECT k.a, k.b, count(*) AS shared FROM k JOIN e x ON x.doc_id = k.a JOIN e y ON y.doc_id = k.b AND y.g = x.g GROUP BY 1, 2), {COUNTED}"""


def distinct_sql() -> str:
    """All pairs of distinct bodies, each under its smallest id."""
    return f"""{shingle_sql()}, r AS (SELECT min(doc_id) AS doc_id FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)), e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s JOIN r USING (doc_id)), n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2), {COUNTED}"""


def shingle_pairs(t):
    return M.first_holder_pairs(M.bodies(t.documents, "doc_id", "text"))


def distinct_bodies(t):
    return M.distinct_bodies(M.bodies(t.documents, "doc_id", "text"))


SHAPE = "CASE WHEN shared = 0 THEN 'nothing' WHEN shared * 100 >= greatest(n, m) * 98 THEN 'identical' WHEN shared * 10 >= least(n, m) * 9 AND least(n, m) * 3 < greatest(n, m) THEN 'contained, small' WHEN shared * 10 >= least(n, m) * 9 THEN 'contained, large' WHEN shared * 10 >= least(n, m) * 3 THEN 'overlapping' ELSE 'a little' END"


@query("N14_pair_shapes", f"WITH {near_sql()} SELECT a, b, shared, {SHAPE} AS shape FROM p")
def pair_shapes(t):
    return shingle_pairs(t).select("a", "b", "shared", M.pair_shape(F.col("shared"), F.col("n"), F.col("m")).alias("shape"))


@query("N15_rule_verdicts", f"WITH {near_sql()}, q AS (SELECT {SHAPE} AS shape FROM p) SELECT CASE WHEN shape IN ('identical', 'contained, large') THEN 'same' WHEN shape IN ('nothing', 'a little') THEN 'different' ELSE 'person' END AS verdict, count(*) AS n FROM q GROUP BY 1")
def rule_verdicts(t):
    shape = M.pair_shape(F.col("shared"), F.col("n"), F.col("m"))
    return shingle_pairs(t).groupBy(M.verdict(shape).alias("verdict")).agg(F.count("*").alias("n"))


@query("A19_shape_census", f"WITH {near_sql()} SELECT {SHAPE} AS shape, count(*) AS pairs, CAST(floor(median(shared)) AS BIGINT) AS median_shared FROM p GROUP BY 1")
def shape_census(t):
    rows = shingle_pairs(t).withColumn("shape", M.pair_shape(F.col("shared"), F.col("n"), F.col("m")))
    return rows.groupBy("shape").agg(F.count("*").alias("pairs"), F.floor(F.median("shared")).alias("median_shared"))


@query("U7_jaccard_containment", f"WITH {near_sql()} SELECT a, b, round(shared * 1.0 / (n + m - shared), 6) AS jaccard, round(shared * 1.0 / least(n, m), 6) AS containment FROM p")
def jaccard_containment(t):
    s, n, m = F.col("shared"), F.col("n"), F.col("m")
    return shingle_pairs(t).select("a", "b", F.round(s / (n + m - s), 6).alias("jaccard"), F.round(s / F.least(n, m), 6).alias("containment"))


@query("N9_copy_pairs", f"WITH {distinct_sql()} SELECT a, b FROM p WHERE shared * 10 >= (n + m - shared) * 8")
def copy_pairs(t):
    """Pairs of distinct bodies; N13_components has the members of each."""
    return M.near_pairs(distinct_bodies(t)[0]).select("a", "b")


@query("N13_components", f"WITH RECURSIVE {shingle_sql()}, e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2), {COUNTED}, l AS (SELECT a, b FROM p WHERE shared * 10 >= (n + m - shared) * 8), links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT doc_id AS id, doc_id AS label FROM s UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.id) SELECT id, min(label) AS cluster FROM reach GROUP BY 1")
def components(t):
    bodies, members = distinct_bodies(t)
    links = M.near_pairs(bodies).select("a", "b").union(members.filter("id <> rep").select("rep", "id"))
    return M.min_label_components(t.documents.select(F.col("doc_id").alias("id")), links).withColumnRenamed("component", "cluster")


@query("N9_copy_clusters_minhash")
def copy_clusters(t):
    return M.copy_clusters(t.documents, "doc_id", "text")


@query("N10_ordered_clusters")
def ordered_clusters(t):
    sets = M.bodies(t.documents, "doc_id", "text")
    pairs = M.similar_pairs(sets, M.candidates(sets, M.shake_signature(F.col("shingles"))), (3, 10))
    return M.ordered_clusters(pairs, sets)


@query("N11_containment", f"WITH {distinct_sql()} SELECT a, b, n <= m AS first_is_part FROM p WHERE shared * 10 >= least(n, m) * 9 AND shared * 10 < (n + m - shared) * 8")
def containment(t):
    rows = M.part_pairs(distinct_bodies(t)[0]).filter("shared * 10 < (n + m - shared) * 8")
    return rows.select("a", "b", (F.col("n") <= F.col("m")).alias("first_is_part"))


@query("N11_but_for_one_word")
def but_for_one_word(t):
    """Bodies of fewer than 60 shingles that a body with both of their ends holds but for one word."""
    pairs = settled(M.both_ends_pairs(M.bodies(t.documents, "doc_id", "text")))
    w = met_bodies(t, pairs, "part", "holder").select("id", "words")
    w = settled(w)
    both = pairs.join(w.toDF("part", "x"), "part").join(w.toDF("holder", "y"), "holder")
    return both.filter(M.one_word_apart("x", "y")).select("part", "holder")


def met_bodies(t, pairs, one, other):
    """(id, words, shingles) of the bodies that occur in pairs."""
    met = pairs.select(F.explode(F.array(one, other)).alias("doc_id")).distinct()
    return M.bodies(t.documents.join(met, "doc_id", "left_semi"), "doc_id", "text")


@query("J5_end_shingle_join", f"WITH {shingle_sql()}, o AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[1:5], ' '), array_to_string(w[-5:], ' ')])) AS g, len(sh) AS n FROM s WHERE len(sh) > 0), e AS (SELECT doc_id, unnest(sh) AS g, len(sh) AS n FROM s) SELECT DISTINCT o.doc_id AS part, e.doc_id AS holder FROM o JOIN e ON o.g = e.g AND o.doc_id <> e.doc_id AND o.n * 10 >= e.n AND o.n <= e.n")
def end_shingle_join(t):
    return M.end_pairs(M.bodies(t.documents, "doc_id", "text"))


@query("N16_shared_word_mask", f"WITH {near_sql()}, x AS (SELECT a, b FROM p WHERE shared * 10 >= least(n, m) * 5), y AS (SELECT x.a, x.b, s.w, o.sh FROM x JOIN s ON s.doc_id = x.a JOIN s o ON o.doc_id = x.b WHERE len(s.w) >= 5), i AS (SELECT a, b, unnest(generate_series(1, len(w) - 4)) AS p0, w, sh FROM y), h AS (SELECT DISTINCT a, b, p0 + d AS word FROM i, (SELECT unnest([0, 1, 2, 3, 4]) AS d) WHERE list_contains(sh, array_to_string(w[p0:p0+4], ' '))) SELECT a, b, count(*) AS shared_words FROM h GROUP BY 1, 2")
def shared_word_mask(t):
    pairs = settled(shingle_pairs(t).filter("shared * 10 >= least(n, m) * 5").select("a", "b"))
    hashed = lambda runs: F.transform(runs, lambda x: F.xxhash64(x))
    s = settled(met_bodies(t, pairs, "a", "b").select("id", hashed(X.word_runs(F.col("words"), M.K)).alias("runs"), hashed(F.col("shingles")).alias("keys")))
    j = pairs.join(s.select(F.col("id").alias("a"), "runs"), "a").join(s.select(F.col("id").alias("b"), "keys"), "b").filter(F.size("runs") > 0)
    return j.select("a", "b", M.covered_words("runs", "keys").alias("shared_words")).filter("shared_words > 0")


@query("N17_short_cite_keys", "SELECT c_custkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(c_name || ', 20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '!'), '[^0-9a-z ]+', ' ', 'g'), ' +', ' ', 'g')), '\\b(19|20)([0-9]{2})\\b', '\\2', 'g') AS cite_key FROM customer")
def short_cite_keys(t):
    cite = F.concat("c_name", F.lit(", 20"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("!"))
    return t.customer.select("c_custkey", X.short_cite_key(cite).alias("cite_key"))


BODY = "string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' ')"


@query("N18_anchors", f"WITH b AS (SELECT item_id, {BODY} AS w FROM benchmark) SELECT item_id, array_to_string(w[1:4], ' ') AS opening, array_to_string(w[-4:], ' ') AS closing FROM b WHERE len(w) >= 8")
def anchors(t):
    w = F.split(X.tag_words(F.col("text")), " ")
    short = F.concat(F.slice(w, 1, 4), F.array(F.lit("...")), F.slice(w, -4, 4))
    b = t.benchmark.filter(F.size(w) >= 8).select("item_id", M.abbreviation_anchor(short).alias("a"))
    return b.select("item_id", F.array_join("a.opening", " ").alias("opening"), F.array_join("a.closing", " ").alias("closing"))


#: abbreviated forms of every document: three to eight words of each end, by its own length, under its language
ENDS = f"b AS (SELECT doc_id, lang AS key, {WORDS} AS w FROM documents), x AS (SELECT *, 3 + len(w) % 6 AS i, 3 + (len(w) // 6) % 6 AS j FROM b WHERE len(w) >= 8 AND key IS NOT NULL), y AS (SELECT doc_id, key, w, w[1:i] AS o, w[len(w) - j + 1:] AS c FROM x)"


def abbreviated(t):
    b = t.documents.filter("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("key"), X.matching_words(F.col("text")).alias("words")).filter(F.size("words") >= 8)
    n = F.size("words")
    i, j = (n % 6 + 3).cast("int"), (F.floor(n / 6) % 6 + 3).cast("int")
    return b.select("id", "key", "words", F.slice("words", F.lit(1), i).alias("opening"), F.slice("words", n - j + 1, j).alias("closing"))


@query("N19_link_abbreviated", f"""WITH {ENDS}, f AS (SELECT md5(array_to_string(w, ' ')) AS body, key, any_value(w) AS w, count(*) AS copies FROM y GROUP BY 1, 2),
g AS (SELECT *, list_distinct(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k:k+4], ' '))) AS sh FROM f),
m AS (SELECT y.doc_id AS id, g.body, g.copies, g.sh FROM y JOIN g ON g.key = y.key AND g.w[1:len(y.o)] = y.o AND g.w[len(g.w) - len(y.c) + 1:] = y.c AND len(y.o) + len(y.c) <= len(g.w)),
h AS (SELECT id, first(body ORDER BY copies DESC, body) AS chosen FROM m GROUP BY 1),
u AS (SELECT m.id, bool_or(m.body <> h.chosen AND 2 * len(list_intersect(m.sh, i.sh)) < least(len(m.sh), len(i.sh))) AS split FROM m JOIN h USING (id) JOIN m i ON i.id = m.id AND i.body = h.chosen GROUP BY 1)
SELECT id, CASE WHEN NOT split THEN chosen END AS cluster FROM u JOIN h USING (id)""")
def link_abbreviated(t):
    """Every document's abbreviated form with the full body that it is a cut of; equal bodies are one cluster, near copies others."""
    b = settled(abbreviated(t))
    body = F.md5(F.array_join("words", " "))
    full = b.groupBy(body.alias("body"), "key").agg(F.any_value("words").alias("words"), F.count("*").alias("copies"))
    full = full.withColumn("cluster", F.col("body"))
    return AB.link_abbreviated(b.select("id", "key", "opening", "closing", F.lit(False).alias("from_cite")), full)


@query("N20_unmatched_groups", f"""WITH RECURSIVE {ENDS}, e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b ON a.key = b.key AND a.doc_id <> b.doc_id AND a.o[1:3] = b.o[1:3] AND a.c[-3:] = b.c[-3:]
 AND a.o[1:least(len(a.o), len(b.o))] = b.o[1:least(len(a.o), len(b.o))] AND a.c[-least(len(a.c), len(b.c)):] = b.c[-least(len(a.c), len(b.c)):] AND greatest(least(len(a.o), len(b.o)), least(len(a.c), len(b.c))) >= 5),
r AS (SELECT doc_id AS id, doc_id AS label FROM y UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(label) AS grp FROM r GROUP BY 1),
l AS (SELECT grp, first(y.o ORDER BY len(y.o) DESC) AS o, first(y.c ORDER BY len(y.c) DESC) AS c FROM c JOIN y ON y.doc_id = c.id GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT grp FROM c JOIN y ON y.doc_id = c.id JOIN l USING (grp) GROUP BY 1 HAVING bool_and(l.o[1:len(y.o)] = y.o AND l.c[-len(y.c):] = y.c))
SELECT id, grp FROM c JOIN k USING (grp)""")
def unmatched_groups(t):
    return AB.unmatched_groups(abbreviated(t))


@query("N21_holders_of_two", f"""WITH {distinct_sql()}, h AS (SELECT CASE WHEN n >= m THEN a ELSE b END AS holder, CASE WHEN n >= m THEN b ELSE a END AS part FROM p WHERE shared * 10 >= least(n, m) * 9),
z AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM s WHERE len(w) >= 5)),
q AS (SELECT holder, part, min(x.pos) AS start, max(x.pos) + 5 AS stop FROM h JOIN z x ON x.doc_id = holder JOIN (SELECT DISTINCT doc_id, g FROM z) y ON y.doc_id = part AND y.g = x.g GROUP BY 1, 2)
SELECT holder, count(*) AS parts FROM q GROUP BY 1 HAVING min(stop) <= max(start)""")
def holders_of_two(t):
    reps = settled(distinct_bodies(t)[0])
    rows = M.part_pairs(reps)
    larger = F.col("n") >= F.col("m")
    h = rows.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("holder"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("part"))
    w = M.bodies(t.documents, "doc_id", "text").select("id", "words")
    return AB.holders_of_two(h.distinct(), w)


RUN = 12
LOWER_WORDS = "list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda x: x <> '')"


QUOTED = f"""WITH d AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents), b AS (SELECT item_id, {LOWER_WORDS} AS w FROM benchmark),
x AS (SELECT doc_id, i AS pa, md5(array_to_string(w[i:i+11], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 12)), y AS (SELECT item_id, i AS pb, md5(array_to_string(w[i:i+11], ' ')) AS k FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 12)),
j AS (SELECT doc_id, item_id, pa, pb, pa - row_number() OVER (PARTITION BY doc_id, item_id, pa - pb ORDER BY pa) AS island, pa - pb AS diag FROM x JOIN y USING (k))
SELECT doc_id, item_id, count(*) + 11 AS words, min(pa) AS start, min(pb) AS source_start FROM j GROUP BY doc_id, item_id, diag, island"""


@query("N23_quoted_runs", QUOTED)
def quoted_runs(t):
    d = t.documents.select(F.col("doc_id").alias("id"), X.words(F.col("text")).alias("words"))
    b = t.benchmark.select(F.col("item_id").alias("id"), X.words(F.col("text")).alias("words"))
    return M.quoted_runs(d, b, RUN).withColumnsRenamed({"text_id": "doc_id", "source_id": "item_id"})


@query("N22_uncovered_words", QUOTED.replace("\nSELECT doc_id, item_id, count(*)", ",\nq AS (SELECT doc_id, item_id, count(*)") + """), g AS (SELECT doc_id, start, start + words AS stop, max(start + words) OVER (PARTITION BY doc_id ORDER BY start, start + words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
u AS (SELECT doc_id, CAST(sum(greatest(0, stop - greatest(start, coalesce(reach, start)))) AS BIGINT) AS covered FROM g GROUP BY 1) SELECT doc_id, covered, len(w) - covered AS uncovered FROM u JOIN d USING (doc_id)""")
def uncovered_words(t):
    """Words of a document that the passages it has in common with benchmark items cover, and those in none."""
    n = t.documents.select(F.col("doc_id").alias("id"), F.size(X.words(F.col("text"))).alias("n"))
    runs = quoted_runs(t).select(F.col("doc_id").alias("id"), F.col("start").cast("int").alias("start"), (F.col("start") + F.col("words")).cast("int").alias("end")).join(n, "id")
    return AB.trims(runs, "n").select(F.col("id").alias("doc_id"), F.col("covered").cast("bigint").alias("covered"), F.col("uncovered").cast("bigint").alias("uncovered"))


@query("N24_marker_census", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN length(line) > 60 THEN 'long' WHEN regexp_matches(line, '^[A-Z0-9 !.,]+$') THEN 'capitals' WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS form, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM l GROUP BY 1")
def marker_census(t):
    line = F.col("line")
    form = F.when(F.trim(line) == "", "blank").when(F.length(line) > 60, "long").when(line.rlike("^[A-Z0-9 !.,]+$"), "capitals").when(line.contains("|"), "table").otherwise("text")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(form.alias("form")).agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("documents"))


@query("A42_cluster_evaluation", f"WITH {near_sql()}, q AS (SELECT a, b, shared * 10 >= (n + m - shared) * 8 AS found, shared * 10 >= least(n, m) * 7 AS truth FROM p) SELECT count(*) FILTER (found AND truth) AS tp, count(*) FILTER (found AND NOT truth) AS fp, count(*) FILTER (NOT found AND truth) AS fn FROM q")
def cluster_evaluation(t):
    rows = shingle_pairs(t).select((F.expr("shared * 10 >= (n + m - shared) * 8")).alias("found"), F.expr("shared * 10 >= least(n, m) * 7").alias("truth"))
    return rows.agg(F.count_if(F.expr("found and truth")).alias("tp"), F.count_if(F.expr("found and not truth")).alias("fp"), F.count_if(F.expr("not found and truth")).alias("fn"))


@query("N12_cut_step")
def cut_step(t):
    bodies, members = distinct_bodies(t)
    rows = M.part_pairs(bodies).filter("n <> m")
    small = F.col("n") < F.col("m")
    held = rows.select(F.when(small, F.col("a")).otherwise(F.col("b")).alias("part"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("holder"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"))
    own = members.select("id", F.col("rep").alias("cluster"))
    return M.cut_step(own, held)

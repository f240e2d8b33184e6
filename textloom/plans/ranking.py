"""Queries of the retrieval and ranking family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.operators import cohorts as C
from textloom.operators import learned
from textloom.operators import pages as P
from textloom.operators import retrieval as R
from textloom.plans.registry import query

#: queries of a vector search that are broadcast at once
QUERY_BLOCK = 2000
TERMS = ["the", "eaan", "thand", "policy", "ofthe"]
TOKENS = "list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '')"


def bm25_sql(where: str = "true") -> str:
    tf = ", ".join(f"CAST(len(list_filter(tokens, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS dtf{i}" for i in range(len(TERMS)))
    gain = " + ".join(f"ln(1 + (n_docs - dtf{i} + 0.5) / (dtf{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(TERMS)))
    return f"""t AS (SELECT doc_id, lang, source, n_chars, {TOKENS} AS tokens FROM documents WHERE {where}), c AS (SELECT doc_id, lang, source, n_chars, len(tokens) AS len, {tf} FROM t),
st AS (SELECT count(*) AS n_docs, avg(len) AS avg_len, {df} FROM c), b AS (SELECT doc_id, lang, source, n_chars, {gain} AS bm25 FROM c, st)"""


@query("R3_bm25_topk", f"WITH {bm25_sql()} SELECT doc_id, round(bm25, 6) AS score, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 20")
def bm25_topk(t):
    rows = R.bm25(t.documents, TERMS).select("doc_id", F.round("bm25", 6).alias("score"))
    return R.ranked(rows, 20, F.asc("doc_id"))


AGE = "date_diff('day', DATE '2024-01-01' - CAST(doc_id % 900 AS INTEGER), DATE '2024-01-01')"
FEATURE_SQL = f"""{bm25_sql("lang <> 'de'")}, m AS (SELECT max(bm25) AS top FROM b),
f AS (SELECT doc_id, bm25 / nullif(top, 0) AS bm25, CASE WHEN doc_id % 10 <> 0 THEN pow(0.5, (doc_id % 900) / 90.0) END AS recency,
 CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.6 ELSE 0.3 END AS source_type, CAST(NULL AS DOUBLE) AS peer_reviewed, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0 END AS open_access,
 CASE WHEN lang = 'en' THEN least(1.0, ln(1 + n_chars) / ln(1001)) END AS citations, (doc_id % 4) / 4.0 AS agreement FROM b, m),
s AS (SELECT *, coalesce(bm25, 0) * 0.45 + coalesce(recency, 0) * 0.15 + coalesce(source_type, 0) * 0.1 + coalesce(open_access, 0) * 0.05 + coalesce(citations, 0) * 0.1 + coalesce(agreement, 0) * 0.05 AS raw FROM f)"""


def features(t):
    """Candidates with the ranking's features; the source-type filter comes before BM25 is scaled."""
    rows = R.bm25(t.documents.filter("lang <> 'de'"), TERMS, carry=("lang", "n_chars"))
    top = rows.agg(F.max("bm25").alias("top"))
    d = F.col("doc_id")
    return rows.crossJoin(F.broadcast(top)).select(  # one row
        "doc_id",
        (F.col("bm25") / F.nullif("top", F.lit(0.0))).alias("bm25"),
        F.when(d % 10 != 0, R.recency(d % 900)).alias("recency"),
        F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.6).otherwise(0.3).alias("source_type"),
        F.lit(None).cast("double").alias("peer_reviewed"),
        F.when(d % 3 == 0, 1.0).when(d % 3 == 1, 0.0).alias("open_access"),
        R.citation_score(F.col("n_chars"), F.col("lang") == "en").alias("citations"),
        R.agreement(d % 4 + 1, F.lit(5)).alias("agreement"),
    )


@query("R11_weighted_rank", f"WITH {FEATURE_SQL} SELECT doc_id, round(raw, 6) AS score, row_number() OVER (ORDER BY round(raw, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50")
def weighted_rank(t):
    rows = R.weighted(features(t), R.Weights())
    return R.ranked(rows.select("doc_id", F.round("score", 6).alias("score")), 50, F.asc("doc_id"))


NAMES = ("bm25", "recency", "source_type", "open_access", "citations", "agreement")
WEIGHT = dict(zip(NAMES, (0.45, 0.15, 0.1, 0.05, 0.1, 0.05), strict=True))
UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {R.FEATURES.index(n)} AS i, round({n} * {WEIGHT[n]}, 9) AS part FROM f" for n in NAMES)


@query("R11_explanations", f"WITH {FEATURE_SQL}, p AS ({UNPIVOT}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part DESC, i) AS place FROM p WHERE part > 0) SELECT doc_id, string_agg(name, ', ' ORDER BY place) AS why FROM o WHERE place <= 4 GROUP BY 1")
def explanations(t):
    return R.weighted(features(t), R.Weights()).filter("why <> ''").select("doc_id", "why")


@query("W2_scaled_by_max", f"WITH {bm25_sql()} SELECT doc_id, lang, round(bm25 / nullif(max(bm25) OVER (PARTITION BY lang), 0), 6) AS scaled FROM b")
def scaled_by_max(t):
    rows = R.bm25(t.documents, TERMS).join(t.documents.select("doc_id", "lang"), "doc_id")
    top = rows.groupBy("lang").agg(F.max("bm25").alias("top"))
    return rows.join(F.broadcast(top), "lang").select("doc_id", "lang", F.round(F.col("bm25") / F.nullif("top", F.lit(0.0)), 6).alias("scaled"))  # one row a language


@query("R2_query_terms", "SELECT item_id, list_aggregate(list_filter(" + TOKENS.replace("lambda x: x <> ''", "lambda x: x <> ''") + ", lambda x, i: list_position(" + TOKENS + ", x) = i), 'string_agg', ' ') AS terms FROM benchmark")
def query_terms(t):
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(words(F.col("text"))), " ").alias("terms"))


@query("R4_recency", "SELECT event_id, round(pow(0.5, greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0) / 90.0), 9) AS decayed, round(least(1.0, greatest(0.0, 1 - greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0) / 20.0)), 9) AS windowed FROM events")
def recency(t):
    age = F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    return t.events.select("event_id", F.round(R.recency(age), 9).alias("decayed"), F.round(R.recency(age, F.lit(20.0)), 9).alias("windowed"))


@query("R8_citations", "SELECT p_partkey, CASE WHEN p_size > 10 THEN round(least(1.0, ln(1 + p_retailprice) / ln(1001)), 9) END AS citations FROM part")
def citations(t):
    return t.part.select("p_partkey", F.round(R.citation_score(F.col("p_retailprice"), F.col("p_size") > 10), 9).alias("citations"))


@query("R9_agreement", "SELECT o_custkey, round((count(DISTINCT o_orderstatus) - 1) * 1.0 / nullif(count(*) - 1, 0), 9) AS agreement FROM orders GROUP BY 1")
def agreement(t):
    g = t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("p"), F.count("*").alias("n"))
    return g.select("o_custkey", F.round(R.agreement(F.col("p"), F.col("n")), 9).alias("agreement"))


@query("R6_source_values", "SELECT doc_id, CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.8 ELSE 0.5 END AS source_value FROM documents")
def source_values(t):
    values = F.create_map(F.lit("src0"), F.lit(1.0), F.lit("src1"), F.lit(0.8))
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(values, F.col("source")), F.lit(0.5)).alias("source_value"))


@query("R7_open_access", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS open_access, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0 END AS score FROM documents")
def open_access(t):
    state = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return t.documents.select("doc_id", state.alias("open_access"), state.cast("double").alias("score"))


@query("R5_recency_applies", "SELECT user_id, (max(ts) > TIMESTAMP '2024-01-20' OR bool_or(event_type = 'purchase')) AND count(*) > 1 AS applies FROM events GROUP BY 1")
def recency_applies(t):
    applies = ((F.max("ts") > F.lit("2024-01-20").cast("timestamp_ntz")) | F.bool_or(F.col("event_type") == "purchase")) & (F.count("*") > 1)
    return t.events.groupBy("user_id").agg(applies.alias("applies"))


@query("R17_narrowing", f"WITH {bm25_sql()}, r AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 60), e AS (SELECT rank, lang AS subject FROM r UNION ALL SELECT rank, source FROM r) SELECT subject, count(*) AS results, min(rank) AS best_rank FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 59 ORDER BY results DESC, best_rank, subject LIMIT 5")
def narrowing(t):
    top = R.ranked(R.bm25(t.documents, TERMS).select("doc_id", F.round("bm25", 6).alias("score")), 60, F.asc("doc_id"))
    rows = top.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select("rank", F.array("lang", "source").alias("subjects"))
    return R.narrowing(rows, TERMS)


STOP = {"the", "of", "and", "to", "in"}
PASSAGE = ["the", "thand", "eaan", "and", "heer", "inea", "ofthe", "stin"]


@query("R20_passage_search", f"WITH t AS (SELECT doc_id, list_distinct({TOKENS}) AS tokens FROM documents) SELECT doc_id, len(list_intersect(tokens, ['thand', 'eaan', 'heer', 'inea', 'ofthe', 'stin'])) AS found, 4 AS need FROM t WHERE len(list_intersect(tokens, ['thand', 'eaan', 'heer', 'inea', 'ofthe', 'stin'])) >= 4")
def passage_search(t):
    return R.passage_matches(t.documents, PASSAGE, STOP)


FIELD_TERMS = ("en", "the", "thand", "src3")
#: fixed values: weights of the four fields
FIELD_WEIGHTS = {"tag": 10.0, "cite": 6.0, "read_aloud": 3.0, "body": 1.0}
TOKENIZED = "list_filter(string_split(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g'), ' '), lambda x: x <> '')"


def field_sql() -> str:
    """Four fields of a document: its first line, its source and language, its second line, its text."""
    parts = ", ".join(f"{TOKENIZED.format(c)} AS {n}" for n, c in (("tag", "lines[1]"), ("cite", "source || ' ' || lang"), ("read_aloud", "coalesce(lines[2], '')"), ("body", "text")))
    tf = ", ".join(" + ".join(f"{w} * len(list_filter({f}, lambda x: x = '{term}'))" for f, w in FIELD_WEIGHTS.items()) + f" AS tf{i}" for i, term in enumerate(FIELD_TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(FIELD_TERMS)))
    gain = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in range(len(FIELD_TERMS)))
    some = " + ".join(f"tf{i}" for i in range(len(FIELD_TERMS)))
    return f"WITH l AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents), t AS (SELECT doc_id, {parts} FROM l), c AS (SELECT doc_id, {tf}, len(tag) + len(cite) + len(read_aloud) + len(body) AS len FROM t), s AS (SELECT count(*) AS n, avg(len) AS al, {df} FROM c) SELECT doc_id, round(-({gain}), 6) AS score FROM c, s WHERE {some} > 0"


@query("R19_field_weighted", field_sql())
def field_weighted(t):
    """BM25 over four fields: weighted counts before saturation, and lower scores for better rows."""
    lines = F.split("text", "\n")
    fields = {"tag": words(F.get(lines, F.lit(0))), "cite": words(F.concat_ws(" ", "source", "lang")), "read_aloud": words(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))), "body": words(F.col("text"))}
    return R.field_bm25(t.documents, "doc_id", fields, FIELD_WEIGHTS, FIELD_TERMS).select("doc_id", F.round("score", 6).alias("score"))


def held_out(doc_id):
    """A fifth of the ids, which nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def text_model(t):
    """A model of language and quality, learned from the labelled documents that are not held out."""
    labelled = t.labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = t.documents.filter(~held_out(F.col("doc_id"))).join(labelled, "doc_id")
    return learned.fit(rows.select(words(F.col("text")).alias("tokens"), F.concat_ws(":", "lang", "quality").alias("label")), "tokens", "label")


@query("R27_tfidf_predict")
def tfidf_predict(t):
    model, rows = text_model(t), t.documents.select("doc_id", words(F.col("text")).alias("tokens"))
    out = learned.predict(rows, "doc_id", "tokens", model)
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "label", F.round("probability", 4).alias("probability"))


@query("R28_namespaced_grams", f"WITH t AS (SELECT item_id, {TOKENS} AS w FROM benchmark), g AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: 'tag:' || w[i] || ' ' || w[i + 1])) AS gram FROM t UNION ALL SELECT item_id, 'tag:' || unnest(w) FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1")
def namespaced_grams(t):
    w = words(F.col("text"))
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.lit("tag:"), F.array_join(F.slice(w, i, 2), " "))))
    grams = F.concat(F.transform(w, lambda x: F.concat(F.lit("tag:"), x)), F.coalesce(two, F.array().cast("array<string>")))
    return t.benchmark.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")


@query("R29_queue_order", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN n_chars % 3 <> 0 THEN n_chars END DESC, doc_id) AS place FROM documents QUALIFY place <= 100")
def queue_order(t):
    d = t.documents.select("doc_id", "n_chars", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).alias("score"))
    order = [F.col("score").isNull(), F.desc("score"), F.asc("doc_id")]
    return d.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("score")  # a page of the queue


@query("R25_vector_topk", "WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q_id, vec_id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 5) AS score FROM q, embeddings WHERE q_id <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def vector_topk(t):
    """Cosine similarity of the stated queries, every row whose id is divisible by 100, with all rows."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return R.nearest_by_cosine(e, e.filter("vec_id % 100 = 0"), 10, QUERY_BLOCK)


@query("R26_pricing_units", "SELECT user_id, CAST(ceil(count(*) / 100.0) AS BIGINT) AS units FROM events GROUP BY 1")
def pricing_units(t):
    return t.events.groupBy("user_id").agg(F.ceil(F.count("*") / 100).alias("units"))


@query("A31_precision_threshold", "WITH s AS (SELECT l.quality AS hit, round(n_chars / 1000.0, 1) AS score FROM labels l JOIN documents USING (doc_id)), g AS (SELECT score, sum(hit) AS h, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, sum(h) OVER (ORDER BY score DESC) AS h, sum(n) OVER (ORDER BY score DESC) AS n FROM g) SELECT min(score) AS threshold, max(n) AS covered FROM c WHERE h >= 0.86 * n")
def precision_threshold(t):
    s = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("hit"), F.round(F.col("n_chars") / 1000.0, 1).alias("score"))
    return C.precision_threshold(s, 0.86)


@query("A32_ndcg", "WITH g AS (SELECT lang, doc_id, quality + toxic AS grade, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM labels JOIN documents USING (doc_id)), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY grade DESC, rank) AS ideal FROM g) SELECT lang, round(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) / nullif(sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) END), 0), 6) AS ndcg FROM i GROUP BY 1")
def ndcg(t):
    j = t.labels.join(t.documents, "doc_id").select("lang", (F.col("quality") + F.col("toxic")).alias("grade"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return R.ndcg(j, "lang", 10).select("lang", F.round("ndcg", 6).alias("ndcg"))


@query("A33_unit_f1", "WITH p AS (SELECT quality, CASE WHEN length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) * 100 < length(text) * 93 THEN 0 ELSE 1 END AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality = 0 AND guess = 1) AS fp, count(*) FILTER (quality = 1 AND guess = 0) AS fn FROM p) SELECT tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def unit_f1(t):
    """F1 of a guess by the share of letters and blanks, at least 93 in 100."""
    plain = F.length(F.regexp_replace("text", "[^A-Za-z ]", ""))
    p = t.labels.join(t.documents, "doc_id").select("quality", F.when(plain * 100 < F.length("text") * 93, 0).otherwise(1).alias("guess"))
    pair = lambda q, g: F.count_if((F.col("quality") == q) & (F.col("guess") == g))
    c = p.agg(pair(1, 1).alias("tp"), pair(0, 1).alias("fp"), pair(1, 0).alias("fn"))
    return c.withColumn("f1", F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query("T1_page", "SELECT doc_id, n_chars, CAST((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 11 AS INTEGER) AS page FROM documents QUALIFY page < 3")
def page(t):
    """Three pages of a ranked search, each found from the cursor that the one before it gave."""
    rows, order, cursor, out = t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], None, None
    for number in range(3):
        found, cursor = P.page(rows, order, 11, "documents by length", cursor)
        found = found.withColumn("page", F.lit(number))
        out = found if out is None else out.unionByName(found)
        if cursor is None:
            break
    return out


@query("T2_capped_count", "SELECT least(count(*), 1000) AS shown, count(*) > 1000 AS more FROM (SELECT 1 FROM lineitem WHERE l_quantity > 40 LIMIT 1001)")
def capped_count(t):
    some = t.lineitem.filter("l_quantity > 40").limit(1001)  # an exact count up to its cap
    return some.agg(F.least(F.count("*"), F.lit(1000)).alias("shown"), (F.count("*") > 1000).alias("more"))


@query("T3_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def keyset_page(t):
    return t.orders.filter("o_orderkey > 500").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


@query("T4_shared_word_candidates", f"WITH t AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS word FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS word FROM documents), s AS (SELECT doc_id, item_id, count(*) AS shared FROM t JOIN d USING (word) WHERE word NOT IN ('the', 'of', 'and', 'to', 'in') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS place FROM s) SELECT doc_id, item_id, shared, place FROM r WHERE place <= 3")
def shared_word_candidates(t):
    one = lambda df, key: df.select(key, F.explode(F.array_distinct(words(F.col("text")))).alias("word")).filter(~F.col("word").isin(*STOP))
    s = one(t.documents, "doc_id").join(one(t.benchmark, "item_id"), "word").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return C.top_per_group(s, ["doc_id"], [F.desc("shared"), F.asc("item_id")], 3).drop("more")


@query("T6_batches", "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 20 AS batch FROM documents")
def batches(t):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select("source", "doc_id", F.floor((place - 1) / 20).alias("batch"))


@query("T7_stop_after_verified", "WITH r AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, event_id FROM r WHERE coalesce(before, 0) < 3")
def stop_after_verified(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w)
    return t.events.select("user_id", "event_id", done.alias("before")).filter("coalesce(before, 0) < 3").drop("before")

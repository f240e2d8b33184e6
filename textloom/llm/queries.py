"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.decontaminate import leaks
from textloom.llm.divergence import divergence
from textloom.llm.hard_negatives import hard_negatives
from textloom.llm.hilbert import neighbours
from textloom.llm.jaccard_join import jaccard_components
from textloom.llm.lm_score import lm_scores
from textloom.llm.mixing import mixed
from textloom.llm.quality import quality_scores
from textloom.llm.secret_scan import secret_scan
from textloom.llm.shared import new_path
from textloom.llm.slots import sharded
from textloom.llm.substring_dedup import substring_dedup
from textloom.llm.url_rules import url_verdicts
from textloom.llm.warc import ORACLE as WARC_ORACLE
from textloom.llm.warc import captures, page_captures, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_captures(captures(read_warc(spark, path, payloads=False)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_list").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def base_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12_sharding that SQL can follow."""
    return op12_sharding(spark, sf_dir).select("doc_id", "size", "law")


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_url_rules that SQL can follow."""
    return op2_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_secret_scan that SQL can follow."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_mixing that SQL can follow."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_rules": op2_url_rules,
    "op3_warc": op3_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_lm_score": op10_lm_score,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_hard_negatives": op13_hard_negatives,
    "base_shard_sizes": base_shard_sizes,
    "base_url_rules": base_url_rules,
    "base_secret_spans": base_secret_spans,
    "base_mix_targets": base_mix_targets,
}
WORD = r"[^\x20\x09-\x0D]+"
DEDUP_ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
k AS (SELECT doc_id, q, word, list(word) OVER run AS s, count(*) OVER run AS n FROM x WINDOW run AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT array_to_string(s, ' ') AS s, min(doc_id) AS least FROM k WHERE n = 13 GROUP BY 1),
h AS (SELECT k.doc_id, k.q, k.word, CASE WHEN n = 13 AND f.least < k.doc_id THEN 1 ELSE 0 END AS copy FROM k LEFT JOIN f ON f.s = array_to_string(k.s, ' ') AND k.n = 13),
g AS (SELECT doc_id, q, word, max(copy) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM h),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
JACCARD_ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
k AS (SELECT doc_id, list(word) OVER run AS s, count(*) OVER run AS n FROM x WINDOW run AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, array_to_string(s, ' ') AS s FROM k WHERE n = 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS label FROM d UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.id),
c AS (SELECT id, min(label) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)
"""
URL_ORACLE = """
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE
 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u
"""
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
SECRET_ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '({NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
 len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM t
"""
MIX_ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY 1),
w AS (SELECT *, CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 3.0 * n / weight AS full_at FROM w),
c AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level FROM r WINDOW o AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, (full_at, place)) AS level FROM c WHERE full_at >= level)
SELECT doc_id, size, n AS source_size, round(least(3.0 * n, weight * coalesce(l.level, 1e18)), 4) AS target FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source, l
"""
DIVERGENCE_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM x GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
s AS (SELECT lang, source FROM d GROUP BY 1, 2),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
f AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
  CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (v.lang_total + 2 * v.v) AS HUGEINT) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = s.lang AND t.source = s.source LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM f WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
NEGATIVES_ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
SHARD_ORACLE = "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, 'bytes' AS law FROM documents"
ORACLES: dict[str, str] = {
    "op11_divergence": DIVERGENCE_ORACLE, "op13_hard_negatives": NEGATIVES_ORACLE, "base_shard_sizes": SHARD_ORACLE,
    "base_url_rules": URL_ORACLE, "base_secret_spans": SECRET_ORACLE, "base_mix_targets": MIX_ORACLE,
    "op1_substring_dedup": DEDUP_ORACLE, "op3_warc": WARC_ORACLE, "op7_jaccard_join": JACCARD_ORACLE}

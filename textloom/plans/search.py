"""Queries of snippets and of searches under a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import budgeted as B
from textloom.operators.snippets import best_windows
from textloom.plans.ranking import PASSAGE, STOP, TERMS, TOKENS
from textloom.plans.registry import query

_TERMS = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"


@query("R22_snippets", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w), m AS (SELECT doc_id, pos, regexp_replace(lower(word), '[^0-9a-z]+', '', 'g') AS term FROM x WHERE list_contains({_TERMS}, term)),
v AS (SELECT doc_id, pos, count(DISTINCT term) OVER ahead AS found, count(*) OVER ahead AS hits FROM m WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING)),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY found DESC, hits DESC, pos) = 1),
s AS (SELECT b.*, words, greatest(0, least(pos, len(words) - 24)) AS start FROM b JOIN w USING (doc_id))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(found AS INTEGER) AS found, hits, CASE WHEN start > 0 THEN '…' ELSE '' END || array_to_string(list_transform(words[start + 1:start + 24], lambda x: CASE WHEN list_contains({_TERMS}, regexp_replace(lower(x), '[^0-9a-z]+', '', 'g')) THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN start + 24 < len(words) THEN '…' ELSE '' END AS snippet FROM s""")
def snippets(t):
    return best_windows(t.documents, "doc_id", "text", TERMS).withColumnRenamed("key", "doc_id")


#: seconds of the first run of the budgeted search; what is left is resumed
BUDGET = 1.0
WORDS = sorted(set(PASSAGE) - STOP)


@query("R23_budgeted_search", f"WITH t AS (SELECT doc_id, list_intersect(list_distinct({TOKENS}), [{', '.join(repr(w) for w in WORDS)}]) AS hit FROM documents) SELECT doc_id, CAST(len(hit) AS INTEGER) AS found, array_to_string(list_sort(hit), ' ') AS words FROM t WHERE len(hit) >= 2")
def budgeted_search(t):
    """Documents with two words of a passage: a run that stops at its budget, and one that goes on from the cursor to the end."""
    wanted = F.array(*map(F.lit, WORDS))

    def search(rows):
        tokens = F.split(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " "), " ")
        hit = F.array_sort(F.array_intersect(wanted, tokens))
        return rows.select("doc_id", F.size(hit).alias("found"), F.array_join(hit, " ").alias("words")).filter("found >= 2")

    asked, d = f"words {WORDS} at least 2", t.documents
    cursor = B.begin(d, "doc_id", asked, ranges=8)
    if not B.advance(d, "doc_id", cursor, asked, search, BUDGET):
        B.advance(d, "doc_id", cursor, asked, search, None)
    return B.found(t.spark, cursor, "doc_id long, found int, words string")

"""Snippets: of each text the stretch of some words that holds most of a query's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words of a snippet, marks around a match, and what stands where a text goes on
TOKENS, OPEN, CLOSE, ELLIPSIS = 24, "[", "]", "…"


def best_windows(df: DataFrame, key: str, text: str, terms: list[str], tokens: int = TOKENS) -> DataFrame:
    """(key, start, found, hits, snippet) of each row with a term.

    Every match begins a window; its value is the number of different terms in
    the ``tokens`` words from there on, then of all matches.  The best window is
    taken, ties to the first, and widened to the left where the text ends
    before it is full.  Only matches are exploded and windowed, not words.
    """
    wanted = F.array(*(F.lit(x) for x in sorted(set(terms))))
    words = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    rows = df.select(F.col(key).alias("key"), words.alias("words"))
    plain = F.transform("words", lambda x: F.regexp_replace(F.lower(x), "[^0-9a-z]+", ""))
    met = F.filter(F.transform(plain, lambda x, i: F.struct(i.alias("at"), x.alias("term"))), lambda x: F.array_contains(wanted, x["term"]))
    rows = rows.withColumn("met", met).filter(F.size("met") > 0)
    ahead = Window.partitionBy("key").orderBy("at").rangeBetween(0, tokens - 1)
    hits = rows.select("key", F.explode("met").alias("m")).select("key", F.col("m.at").alias("at"), F.col("m.term").alias("term"))
    valued = hits.select("key", "at", F.size(F.collect_set("term").over(ahead)).alias("found"), F.count("*").over(ahead).alias("hits"))
    best = valued.groupBy("key").agg(F.max(F.struct("found", "hits", (-F.col("at")).alias("back"))).alias("b"))
    joined = rows.join(best, "key")
    size = F.size("words")
    start = F.greatest(F.lit(0), F.least(-F.col("b.back"), size - tokens))
    shown = F.transform(F.slice("words", start + 1, tokens), lambda x: F.when(F.array_contains(wanted, F.regexp_replace(F.lower(x), "[^0-9a-z]+", "")), F.concat(F.lit(OPEN), x, F.lit(CLOSE))).otherwise(x))
    text = F.concat(F.when(start > 0, F.lit(ELLIPSIS)).otherwise(""), F.array_join(shown, " "), F.when(start + tokens < size, F.lit(ELLIPSIS)).otherwise(""))
    return joined.select("key", start.alias("start"), F.col("b.found").alias("found"), F.col("b.hits").alias("hits"), text.alias("snippet"))

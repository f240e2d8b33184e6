"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

A URL is a basket of tokens: labels of its host, segments of its path (digits
as #), query names, fragment.  Baskets of labelled URLs have their label.
Frequent combinations are mined by levels up to a rule's length: Spark's
FP-growth has no bound of length, and a path of sixteen segments that repeats
in a twentieth of the baskets gives it half a million sets and no end.  Rules
from tokens to the bad label are kept by support, confidence and length.  An inverted index holds
each rule under its rarest token alone; a URL blocks when all tokens of a rule
met there are its own.  Rules are matched on distinct baskets, not on rows.

Fixed rules come first: a rule fits its host and all subdomains when the path
starts with the rule's, the longest wins, and what none fits is left to the
mined rules, which allow unless one of them blocks.

Cases: a null url, or one without ://, has empty host and path, no tokens and
is allowed; without labels of both kinds nothing is mined; conflicting labels
of one id count as bad when at least half of them are; repeated rows are each
judged; a null page_id is never labelled; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import written

#: fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LONGEST = 0.005, 0.6, 3
#: deviations by which the confidence of a rule has to exceed the share of bad pages among all labelled ones
SURE = 2.6
SALT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The basket of a URL, sorted and distinct."""
    hashed = F.regexp_replace(path, "[0-9]+", "#")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "=[^&]*", "")

    def named(prefix: str, text: Column, by: str) -> Column:
        return F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    fragment = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(named("host:", host, r"\."), named("path:", hashed, "/"), named("query:", query, "&"), F.coalesce(fragment, F.array().cast("array<string>")))
    return F.when(host != "", F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def token_classes(same: DataFrame, least: float) -> DataFrame:
    """(token, rep, freq, bad) of the tokens that at least ``least`` bad baskets hold; tokens of just the same baskets share a name (rep).

    A long path that repeats is one class so, whatever its length.
    """
    sums = same.select("basket", "n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("freq"), F.sum("bad").alias("bad"), F.bit_xor("basket").alias("where"), F.bit_xor(F.xxhash64("basket")).alias("there"), F.count("*").alias("baskets")
    ).filter(F.col("bad") >= least)
    alike = ["freq", "bad", "where", "there", "baskets"]
    return sums.join(sums.groupBy(*alike).agg(F.min("token").alias("rep")), alike).select("token", "rep", "freq", "bad")


def mined_rules(baskets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(rule_id, tokens, rarest, confidence, support) from labelled baskets (tokens, bad), and the classes of tokens (token, rep) that the rules name.

    A rule's tokens and label occur together in at least ``support`` of the
    baskets; the lower bound of its confidence (Wilson's interval, ``SURE``
    deviations) is above the share of bad baskets, so that a rule of a few rows
    is not chance; one that has another rule in it is pruned.  Sets grow by
    levels, a token at a time: only a set that is frequent with the bad label
    and holds no rule goes to the next level, and the last level is ``longest``.
    """
    n, share = baskets.agg(F.count("*"), F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0))).first()
    least = max(1.0, support * n)
    same = baskets.filter(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    same = written(same.withColumn("basket", F.xxhash64("tokens")), "baskets")
    classes = written(token_classes(same, least), "tokens")
    rows = same.select("basket", "n", F.col("bad").alias("bads"), F.explode("tokens").alias("token")).join(classes.select("token", "rep"), "token")
    rows = rows.select("basket", "n", "bads", F.array("rep").alias("tokens")).distinct()
    p, held = F.col("bad") / F.col("freq"), F.col("freq")
    low = (p + SURE**2 / (2 * held) - SURE * F.sqrt(p * (1 - p) / held + SURE**2 / (4 * held * held))) / (1 + SURE**2 / held)
    rules: DataFrame | None = None
    for level in range(1, longest + 1):
        sets = rows.groupBy("tokens").agg(F.sum("n").alias("freq"), F.sum("bads").alias("bad")).filter(F.col("bad") >= least)
        if level > 2:  # a set of two has open tokens only; a longer one may have a rule in it
            parts = sets.select("tokens", F.explode(F.transform(F.sequence(F.lit(1), F.lit(level)), lambda i: F.concat(F.slice("tokens", F.lit(1), i - 1), F.slice("tokens", i + 1, level)))).alias("part"))
            sets = sets.join(parts.join(rules.select(F.col("tokens").alias("part")), "part").select("tokens").distinct(), "tokens", "left_anti")
        sets = written(sets.withColumns({"confidence": p, "sure": (p >= confidence) & (low > share)}), f"sets{level}")
        found = sets.filter("sure").select("tokens", "confidence", (F.col("bad") / F.lit(max(n, 1))).alias("support"))
        rules = found if rules is None else rules.unionByName(found)
        if level < longest:
            open_ = written(rows.join(sets.filter(~F.col("sure")).select("tokens"), "tokens"), f"open{level}")
            first, last = F.slice("tokens", 1, level - 1), F.element_at("tokens", -1)
            left = open_.select("basket", "n", "bads", first.alias("first"), last.alias("x"))
            right = open_.select("basket", first.alias("first"), last.alias("y"))
            rows = left.join(right, ["basket", "first"]).filter("x < y").select("basket", "n", "bads", F.concat("first", F.array("x", "y")).alias("tokens"))
    rules = rules.withColumn("rule_id", F.array_join("tokens", " "))
    single = classes.filter("token = rep").select("token", "freq")
    rare = rules.select("rule_id", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return written(rules.join(rare, "rule_id"), "rules"), classes.select("token", "rep")  # their number is bounded by support and length


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the mined rules that fit. ``labels``: doc_id, quality, toxic of the page."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"tokens": tokens_of(F.col("url"), F.col("host"), F.col("path")), "fixed": fixed_rule(F.col("host"), F.col("path"), rules)}).drop("url")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg((F.avg(bad.cast("int")) >= 0.5).alias("bad"))
    baskets = rows.select("page_id", "tokens").join(known, "page_id").select("tokens", "bad")
    found, classes = mined_rules(baskets, support, confidence)
    index = found.select("rule_id", F.col("tokens").alias("needs"), F.col("rarest").alias("token"))
    named = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(classes, "token").groupBy("tokens").agg(F.collect_set("rep").alias("reps"))
    met = named.select("tokens", "reps", F.explode("reps").alias("token")).join(index, "token")
    met = met.filter(F.size(F.array_except("needs", "reps")) == 0).groupBy("tokens").agg(F.array_sort(F.collect_set("rule_id")).alias("mined"))
    # a basket that many pages share is dealt to SALT keys, and its rules to each of them
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = rows.join(met, ["tokens", "salt"], "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.array_join("mined", "; ").alias("mined"))

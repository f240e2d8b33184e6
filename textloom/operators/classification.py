"""Deterministic classification: placement by rules, refinement down a tree, roles, carry-forward, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: confidence of each way to a placement
DIRECT, INHERITED, UNDER_PARENT, ALONE = 1.0, 0.9, 0.9, 0.5
REVIEW = 0.6


def needs_review(position: Column, confidence: Column, threshold: float = REVIEW) -> Column:
    return position.isNull() | (confidence < threshold)


def whole_word(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text of single-spaced words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {phrase} ")


def first_match(*rules: tuple[Column, str], other: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(other)
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def placed(items: DataFrame, overrides: DataFrame, aliases: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, position, confidence, method) of each item, by the nearest heading over it or by its own words.

    ``items``: id, headings array (outermost first), tag words array.  The
    deepest heading that matches places, an override before an alias, and an
    override to null nowhere.  A keyword of one child of that place moves the
    item there; without a place, a keyword of one position alone names it.
    ``keywords``: word, position, parent (null at the top).
    """
    heads = items.select("id", F.size("headings").alias("n"), F.posexplode("headings").alias("depth", "heading"))
    known = overrides.select("heading", "position", F.lit(0).alias("kind")).unionByName(aliases.select("heading", "position", F.lit(1).alias("kind")))
    met = heads.join(known, "heading").filter("kind = 1 or position is not null")
    best = met.groupBy("id").agg(F.max_by(F.struct("position", "kind", (F.col("depth") == F.col("n") - 1).alias("direct")), F.struct("depth", -F.col("kind"), "position")).alias("b"))
    wanted = F.array(*(F.lit(r[0]) for r in keywords.select("word").distinct().orderBy("word").collect()))  # the words of a taxonomy
    words = items.select("id", F.explode(F.array_intersect("tag", wanted)).alias("word")).join(keywords, "word")
    own = words.join(best.select("id", F.col("b.position").alias("at")), "id", "left").filter(F.col("at").isNull() | (F.col("parent") == F.col("at")))
    one = own.groupBy("id").agg(F.count_distinct("position").alias("n"), F.min("position").alias("by_word")).filter("n = 1").drop("n")
    rows = items.select("id").join(best, "id", "left").join(one, "id", "left")
    placed_, worded, override = F.col("b").isNotNull(), F.col("by_word").isNotNull(), F.col("b.kind") == 0
    method = F.when(worded, F.lit("keyword")).when(placed_ & ~F.col("b.direct"), "inherited").when(override, "override").when(placed_, "alias")
    confidence = F.when(worded & placed_, UNDER_PARENT).when(worded, ALONE).when(placed_ & ~F.col("b.direct"), INHERITED).when(placed_, DIRECT)
    return rows.select("id", F.coalesce("by_word", "b.position").alias("position"), confidence.alias("confidence"), method.alias("method"))


def refined(rows: DataFrame, children: DataFrame, depth: int) -> DataFrame:
    """Move each placement down to the one child whose keyword its words hold, level by level.

    ``rows``: id, position, words array; ``children``: parent, child, word.
    """
    for _ in range(depth):
        met = rows.select("id", F.col("position").alias("parent"), F.explode("words").alias("word")).join(children, ["parent", "word"])
        only = met.groupBy("id").agg(F.count_distinct("child").alias("n"), F.min("child").alias("child")).filter("n = 1").drop("n")
        rows = rows.join(only, "id", "left").select("id", F.coalesce("child", "position").alias("position"), "words")
    return rows


def upsert_actions(current: DataFrame, decisions: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, action): add, change, unchanged or kept after decisions are applied."""
    c, d = current.select(key, F.col(value).alias("old"), F.lit(True).alias("was")), decisions.select(key, F.col(value).alias("new"), F.lit(True).alias("is"))
    rows = c.join(d, key, "full_outer")
    action = F.when(F.col("is").isNull(), "kept").when(F.col("was").isNull(), "add").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("change")
    return rows.select(key, F.when(F.col("is"), F.col("new")).otherwise(F.col("old")).alias(value), action.alias("action"))


def release_findings(released: DataFrame, now: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, finding): released ids that vanished or whose fixed fields changed."""
    old = released.select(key, *(F.col(c).alias(f"old_{c}") for c in fixed))
    rows = old.join(now.select(key, *fixed, F.lit(True).alias("there")), key, "left")
    findings = [F.when(F.col("there").isNull(), "vanished"), *(F.when(F.col("there") & ~F.col(c).eqNullSafe(F.col(f"old_{c}")), f"{c} changed") for c in fixed)]
    return rows.select(key, F.explode(F.filter(F.array(*findings), lambda x: x.isNotNull())).alias("finding"))


def worst(status: Column) -> Column:
    """FAIL before WARN before PASS over a group."""
    return F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.max(F.when(status == "FAIL", 3).when(status == "WARN", 2).otherwise(1)))

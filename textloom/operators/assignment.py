"""What each round read, by six methods in order, each of which sees only the rounds that are still open.

A round has documents, and each document a verdict over its plan texts (NAMES,
NONE, CONFLICTING or UNREAD) and another over those under a transition label.
Teams carry what all their rounds agree on.  Everything is first brought to one
row a round, then to one row a team, so a team of any size is a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.storage import settled

#: fixed values: the methods in their order
METHODS = ("PLAN_TEXT", "TEAM_CARRY", "KRITIKAL_AFF_MARKER", "KRITIKAL_AFF_CARRY", "TRANSITION_PLAN_TEXT", "TRANSITION_PLAN_CARRY")


def narrowest(names: Column, ancestors: dict[str, list[str]]) -> Column:
    """Names without those that stand above another one of them, in order."""
    if not ancestors:
        return F.array_sort(names)
    above = F.create_map(*(x for child, up in sorted(ancestors.items()) for x in (F.lit(child), F.array(*map(F.lit, up)))))
    none = F.array().cast("array<string>")
    return F.array_sort(F.filter(names, lambda x: ~F.exists(names, lambda y: F.array_contains(F.coalesce(F.try_element_at(above, y), none), x))))


def _set(name: Column) -> Column:
    """Distinct names that are there; at most as many as the vocabulary has."""
    return F.collect_set(name)


def round_facts(documents: DataFrame, placed: DataFrame, advantage: DataFrame, ancestors: dict[str, list[str]]) -> DataFrame:
    """One row a round: what its documents name, and what speaks against carrying into it."""
    names, moves = F.col("verdict") == "NAMES", F.col("t_verdict") == "NAMES"
    per = documents.groupBy("round").agg(
        F.max("team").alias("team"), _set(F.when(names, F.col("aff"))).alias("_named"), F.coalesce(F.bool_or(F.col("verdict") == "CONFLICTING"), F.lit(False)).alias("_clash"), F.bool_and(F.coalesce(F.col("verdict") == "NONE", F.lit(False))).alias("no_plan"),
        F.coalesce(F.bool_or("marker"), F.lit(False)).alias("marked"), _set(F.when(moves, F.col("t_aff"))).alias("_moved"), F.coalesce(F.bool_or(F.col("t_verdict") == "CONFLICTING"), F.lit(False)).alias("_t_clash"),
        F.bool_and(F.coalesce(F.col("t_verdict"), F.lit("NONE")) == "NONE").alias("t_none"),
    )
    held = placed.groupBy("round").agg(_set(F.col("aff")).alias("placed"))
    rows = per.join(held, "round", "left").join(advantage.select("round").distinct().withColumn("advantage", F.lit(True)), "round", "left")
    named, moved = narrowest(F.col("_named"), ancestors), narrowest(F.col("_moved"), ancestors)
    rows = rows.select("round", "team", named.alias("named"), "_clash", "no_plan", "marked", moved.alias("moved"), "_t_clash", "t_none", F.coalesce("placed", F.array().cast("array<string>")).alias("placed"), F.coalesce("advantage", F.lit(False)).alias("advantage"))
    return rows.withColumns({"conflicting": F.col("_clash") | (F.size("named") > 1), "t_conflicting": F.col("_t_clash") | (F.size("moved") > 1)}).drop("_clash", "_t_clash")


def _one(names: Column) -> Column:
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def assigned(documents: DataFrame, placed: DataFrame, advantage: DataFrame, kritikal: str, ancestors: dict[str, list[str]]) -> DataFrame:
    """(round, aff, method): both null for a round that no method names.

    ``documents``: round, team (or null), verdict, aff, marker, t_verdict,
    t_aff; ``placed``: round, aff (of cards placed in it); ``advantage``: rounds
    whose own file reads an advantage.
    """
    r = settled(round_facts(documents, placed, advantage, ancestors))
    # 1: what the plan texts name
    r = r.withColumn("own", F.when(~F.col("conflicting"), _one(F.col("named"))))
    # 2: a team whose rounds narrow to one carries it into rounds without a plan text
    found = F.array_union("placed", F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast("array<string>")))
    team = r.filter("team is not null").groupBy("team").agg(narrowest(F.array_distinct(F.flatten(F.collect_set(found))), ancestors).alias("all"), F.bool_or("conflicting").alias("clash"))
    team = team.select("team", (F.col("clash") | (F.size("all") > 1)).alias("disagrees"), F.when(~F.col("clash"), _one(F.col("all"))).alias("carries"))
    r = r.join(team, "team", "left").withColumn("disagrees", F.coalesce("disagrees", F.lit(False)))
    open_ = F.col("own").isNull() & (F.size("placed") == 0) & ~F.col("conflicting")
    r = r.withColumn("carried", F.when(open_ & F.col("no_plan"), F.col("carries")))
    # 3: a marker in a round that is open and has no plan text
    open_ &= F.col("carried").isNull()
    r = settled(r.withColumn("open", open_).withColumn("by_marker", F.col("open") & F.col("no_plan") & F.col("marked")))
    # 4: a team with such a round, unless its rounds disagree, an advantage is read or a transition plan names another
    markers = r.filter("by_marker and team is not null").select("team").distinct().withColumn("has_marker", F.lit(True))
    r = r.join(markers, "team", "left")
    by_carry = F.col("open") & ~F.col("by_marker") & F.coalesce("has_marker", F.lit(False)) & ~F.col("disagrees") & F.col("no_plan") & ~F.col("advantage") & (F.size("moved") == 0)
    r = r.withColumn("by_kritikal", by_carry)
    # 5: what plan texts under a transition label name
    r = r.withColumn("still", F.col("open") & ~F.col("by_marker") & ~F.col("by_kritikal"))
    r = r.withColumns({"t_split": F.col("still") & F.col("no_plan") & F.col("t_conflicting"), "t_own": F.when(F.col("still") & F.col("no_plan") & ~F.col("t_conflicting"), _one(F.col("moved")))})
    # 6: a team with such a round whose assigned and placed affs narrow to one
    so_far = F.coalesce("own", "carried", F.when(F.col("by_marker") | F.col("by_kritikal"), F.lit(kritikal)), "t_own")
    r = settled(r.withColumn("so_far", so_far))
    every = F.array_union("placed", F.when(F.col("so_far").isNotNull(), F.array("so_far")).otherwise(F.array().cast("array<string>")))
    t = r.filter("team is not null").groupBy("team").agg(narrowest(F.array_distinct(F.flatten(F.collect_set(every))), ancestors).alias("t_all"), F.bool_or(F.col("t_own").isNotNull()).alias("reads"), F.bool_or(F.col("disagrees") | F.col("t_split")).alias("t_apart"))
    t = t.select("team", F.when(F.col("reads") & ~F.col("t_apart"), _one(F.col("t_all"))).alias("t_carries"))
    r = r.join(t, "team", "left").withColumn("t_carried", F.when(F.col("still") & F.col("t_own").isNull() & ~F.col("t_split") & F.col("no_plan") & F.col("t_none"), F.col("t_carries")))
    steps = (F.col("own"), F.col("carried"), F.when(F.col("by_marker"), F.lit(kritikal)), F.when(F.col("by_kritikal"), F.lit(kritikal)), F.col("t_own"), F.col("t_carried"))
    method = F.coalesce(*(F.when(s.isNotNull(), F.lit(m)) for s, m in zip(steps, METHODS, strict=True)))
    return r.select("round", F.coalesce(*steps).alias("aff"), method.alias("method"))

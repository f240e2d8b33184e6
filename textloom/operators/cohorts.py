"""Cohort transforms over events: weekly windows, shares, trends, first seen, budgets, usage.

The reading of an event: ``user_id`` is the team, ``event_type`` the position,
even teams are aff, and the snapshot is the Sunday that ends the event's week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readings(events: DataFrame) -> DataFrame:
    """(event_id, team, position, side, snapshot, day, round, value, ts) of events."""
    return events.select(
        "event_id",
        F.col("user_id").alias("team"),
        F.col("event_type").alias("position"),
        F.when(F.col("user_id") % 2 == 0, "aff").otherwise("neg").alias("side"),
        F.date_add(F.date_trunc("week", "ts").cast("date"), 6).alias("snapshot"),
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("bigint").alias("round"),
        "value",
        "ts",
    )


def usage_summary(calls: DataFrame, *keys: str, cost: str = "cost", tokens: str = "tokens") -> DataFrame:
    """Calls, tokens (null counts 0), cost of priced calls and number of unpriced ones per group."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"),
        F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 4).alias("cost"),
        F.count_if(F.col(cost).isNull()).alias("unpriced_calls"),
    )


def weekly_shares(reads: DataFrame) -> DataFrame:
    """Teams that read a position in a week, all teams of the week, and the week's share as two whole numbers."""
    teams = reads.groupBy("snapshot").agg(F.count_distinct("team").alias("disclosing"))
    by = reads.groupBy("snapshot", "position").agg(F.count_distinct("team").alias("teams"))
    return by.join(teams, "snapshot")


def trend_labels(reads: DataFrame, points: int = 5, floor: int = 3) -> DataFrame:
    """NEW, RISING, FALLING or STEADY per position and week against the week before, with the held-back flag.

    Shares are compared as exact ratios by cross-multiplication.  A change of
    fewer than ``points`` hundredths is steady, and one that fewer than
    ``floor`` teams carry in both weeks is held back.
    """
    weeks = reads.select("snapshot").distinct()
    weeks = weeks.withColumn("previous", F.lag("snapshot").over(Window.orderBy("snapshot")))  # one row a week
    shares = weekly_shares(reads)
    first = reads.groupBy("position").agg(F.min("snapshot").alias("first_seen"))
    now = shares.join(weeks, "snapshot").join(first, "position")
    before = shares.select(F.col("snapshot").alias("previous"), "position", F.col("teams").alias("previous_teams"))
    totals = shares.select(F.col("snapshot").alias("previous"), F.col("disclosing").alias("previous_disclosing")).distinct()
    rows = now.join(before, ["previous", "position"], "left").join(totals, "previous", "left")
    rows = rows.withColumn("previous_teams", F.when(F.col("previous").isNotNull(), F.coalesce("previous_teams", F.lit(0))))
    gap = F.col("teams") * F.col("previous_disclosing") - F.col("previous_teams") * F.col("disclosing")
    large = F.abs(gap) * 100 >= points * F.col("disclosing") * F.col("previous_disclosing")
    few = F.greatest("teams", "previous_teams") < floor
    label = (
        F.when(F.col("previous").isNull() | (F.col("first_seen") == F.col("snapshot")), "NEW")
        .when(~large | gap.isNull() | few, "STEADY")
        .when(gap > 0, "RISING")
        .otherwise("FALLING")
    )
    held = F.coalesce(F.col("previous").isNotNull() & (F.col("first_seen") < F.col("snapshot")) & large & few, F.lit(False))
    return rows.select("snapshot", "position", "teams", "disclosing", "previous_teams", "previous_disclosing", label.alias("trend"), held.alias("held_back"))


def position_table(reads: DataFrame) -> DataFrame:
    """Per position: rounds, teams, rounds by side, share of its own side's teams, first snapshot, newness."""
    last = reads.agg(F.max("snapshot").alias("last"))
    sides = reads.agg(F.count_distinct(F.when(F.col("side") == "aff", F.col("team"))).alias("all_aff"), F.count_distinct(F.when(F.col("side") == "neg", F.col("team"))).alias("all_neg"))
    aff, neg = F.col("side") == "aff", F.col("side") == "neg"
    rows = reads.groupBy("position").agg(
        F.count_distinct("team", "round").alias("rounds"),
        F.count_distinct("team").alias("teams"),
        F.count_distinct(F.when(aff, F.struct("team", "round"))).alias("aff_rounds"),
        F.count_distinct(F.when(neg, F.struct("team", "round"))).alias("neg_rounds"),
        F.count_distinct(F.when(aff, F.col("team"))).alias("aff_teams"),
        F.min("snapshot").alias("first_seen"),
    )
    rows = rows.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(last))  # one row each
    return rows.select("position", "rounds", "teams", "aff_rounds", "neg_rounds", F.round(F.col("aff_teams") / F.nullif("all_aff", F.lit(0)), 6).alias("aff_share"), "first_seen", (F.col("first_seen") == F.col("last")).alias("is_new"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group and how many more there are. Order must be total."""
    rows = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("in_group", F.count("*").over(Window.partitionBy(*group)))
    return rows.filter(F.col(name) <= n).withColumn("more", F.greatest(F.col("in_group") - n, F.lit(0))).drop("in_group")


def running_budget(calls: DataFrame, window: list[str], limit: float) -> DataFrame:
    """Spend up to and including each call in its window, and whether the call was within the limit."""
    w = Window.partitionBy(*window).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.round(F.sum(F.coalesce("value", F.lit(0.0))).over(w), 4)
    return calls.withColumn("spent", spent).withColumn("within", F.col("spent") <= limit)


def burst_counts(calls: DataFrame, key: str, seconds: int) -> DataFrame:
    """How many calls of the same key started in the interval that ends at each call."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("at", at).withColumn("in_interval", F.count("*").over(w)).drop("at")


def running_sums(levels: DataFrame, order: str, sums: list[str], parts: int = 64) -> DataFrame:
    """``levels`` with the sums of all rows from the highest ``order`` down to each, by ranges.

    ``order`` is unique.  Quantiles cut it into ranges; sums of the ranges, a
    few rows, are added up among themselves, and each range adds its own rows.
    """
    cuts = levels.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<double>"), lambda c: c <= F.col(order).cast("double")))
    rows = levels.withColumn("_part", part)
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums))
    before = totals.select("_part", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in sums))  # ``parts`` rows
    inside = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({f"__{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(before), "_part")
    return out.select(order, *((F.col(f"_{c}") + F.col(f"__{c}")).alias(c) for c in sums))


def precision_threshold(scored: DataFrame, wanted: float) -> DataFrame:
    """The lowest score from which the precision of everything scored as high is at least ``wanted``."""
    levels = scored.groupBy("score").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))  # distinct scores
    cum = running_sums(levels, "score", ["hits", "n"])
    return cum.filter(F.col("hits") >= F.lit(wanted) * F.col("n")).agg(F.min("score").alias("threshold"), F.max("n").alias("covered"))

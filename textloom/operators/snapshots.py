"""Snapshot transforms: what changed, what was withdrawn, what was seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """NEW, UNCHANGED, CHANGED, DUPLICATE (a new key with a digest known before) or REMOVED per key."""
    b = before.select(F.col(key).alias("k0"), F.col(digest).alias("d0"))
    a = after.select(F.col(key).alias("k1"), F.col(digest).alias("d1"))
    known = before.select(F.col(digest).alias("known")).distinct()
    rows = a.join(b, F.col("k0") == F.col("k1"), "full_outer").join(known, F.col("d1") == F.col("known"), "left")
    change = (
        F.when(F.col("k1").isNull(), "REMOVED")
        .when(F.col("k0").isNull() & F.col("known").isNotNull(), "DUPLICATE")
        .when(F.col("k0").isNull(), "NEW")
        .when(F.col("d0").eqNullSafe(F.col("d1")), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return rows.select(F.coalesce("k1", "k0").alias(key), change.alias("change"))


def count_withdrawals(earlier: DataFrame, archive: DataFrame) -> DataFrame:
    """Vanished digests: superseded when a path that any of them had is still there, else withdrawn.

    ``earlier``: snapshot, sha256, path; ``archive``: sha256, path.
    """
    gone = earlier.join(archive.select("sha256").distinct(), "sha256", "left_anti")
    paths = archive.select("path", F.lit(True).alias("there")).distinct()
    kinds = gone.join(paths, "path", "left").groupBy("sha256").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("superseded"))
    counts = kinds.agg(F.count_if(~F.col("superseded")).alias("withdrawn"), F.count_if(F.col("superseded")).alias("superseded"))
    return counts.crossJoin(earlier.agg(F.count_distinct("snapshot").alias("earlier_snapshots")))  # one row each


def unseen(candidates: DataFrame, seen: DataFrame, day: str) -> DataFrame:
    """Candidates none of whose keys was seen on another day. ``candidates``: id, keys array, day; ``seen``: key, day."""
    keyed = candidates.select("id", day, F.explode("keys").alias("key"))
    met = keyed.join(seen.withColumnRenamed(day, "seen_day"), "key").filter(F.col("seen_day") != F.col(day)).select("id").distinct()
    return candidates.join(met, "id", "left_anti")


def latest_as_of(rows: DataFrame, times: DataFrame, key: str, at: str) -> DataFrame:
    """For each (key, at) of ``times`` the latest row of the same key strictly before it.

    Both sides are one ordered stream: a window carries the last row forward,
    so keys are shuffled once and no range join is needed.
    """
    a = rows.select(key, at, F.struct(*rows.columns).alias("row"), F.lit(1).alias("side"))
    b = times.select(key, at, F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("before", F.last("row", ignorenulls=True).over(w))
    return both.filter("side = 0").select(key, at, "before")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has beyond the other, as multisets."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)  # one row each

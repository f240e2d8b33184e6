"""Sharding by fixed virtual slots.

Every record is hashed into one of some thousands of slots, and a map tells
which shard a slot is in.  The map is a small table with versions: version 0
deals the slots out in turn, and each rebalancing writes the next version, in
which only some slots have moved.  The law is ``bytes``: sizes of the shards
near equal.  Spark sums bytes and rows per slot; the editing itself sees one
row a slot, however large the corpus is.

A slot that holds over an eighth of a shard's share of bytes or rows (a very
long text, or one record that repeats very often) is split: its rows are dealt
to sub-slots by their hash and by their place in the input, and the map names
the sub-slots.  At most eight slots a shard can be that large for each of the
two measures, so the table of splits is bounded by the number of shards.

Within a shard rows are numbered without a gap.  No task sees a whole shard for
that: rows are numbered in cells (parts of a slot, of some ten thousands of
rows), and running counts of the cells give each its offset.

Cases: a null text has 0 bytes and the checksum of no bytes, an empty one
likewise; null ids are hashed as such, with their text, so they spread over the
slots; rows that repeat an id and text are rows of their own (they share a slot,
unless it is split); a text longer than a share makes its shard the largest,
which no map can avoid; ties of the editing go to the smaller slot and shard;
an empty table gives an empty result; columns with other names are carried only
where ``carry`` names them.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.shared import new_path, parts_for, written

SLOTS, SHARDS = 8192, 40
#: a slot over 1 / HOT of a share is split into sub-slots of about 1 / FINE of one
HOT, FINE = 8, 64
ROW_BYTES = 16
CELL_ROWS = 20_000

Slot = tuple[int, int]
SHARD_MAP = "slot int, sub int, shard int"


def even_map(slots: list[Slot], shards: int) -> dict[Slot, int]:
    """Version 0: slots in turn."""
    return {slot: slot[0] % shards for slot in slots}


def rebalanced(shard_of: dict[Slot, int], weight: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """The next version of a map: sizes near equal, reached by moving slots from shards over their share.

    A shard over its share gives up the largest slots that fit into the excess,
    the shard with least takes each.  Then single slots move from the largest
    shards to the smallest while that brings the two nearer to each other.
    """
    out, load, held = dict(shard_of), [0] * shards, [[] for _ in range(shards)]
    for slot in sorted(out):
        load[out[slot]] += weight.get(slot, 0)
        held[out[slot]].append(slot)
    share, loose = sum(load) / shards, []
    for k in range(shards):
        for slot in sorted(held[k], key=lambda s: (-weight.get(s, 0), s)):
            w = weight.get(slot, 0)
            if w and load[k] - w >= share:
                load[k] -= w
                loose.append(slot)
    heap = [(n, k) for k, n in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        n, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (n + weight[slot], k))
    return _levelled(out, weight, shards)


def _levelled(out: dict[Slot, int], weight: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """Single moves from the largest shard to the smallest, each bringing them nearer; a shard with no such move is left alone."""
    names = sorted(s for s in out if weight.get(s, 0))
    w, at = np.array([weight[s] for s in names], np.int64), np.array([out[s] for s in names], np.int64)
    load = np.bincount(at, w, shards).astype(np.int64) if len(names) else np.zeros(shards, np.int64)
    open_ = set(range(shards))
    while len(open_) > 1:
        hi = max(open_, key=lambda k: (load[k], -k))
        lo = int(np.argmin(load))
        mine = np.flatnonzero(at == hi)
        fits = mine[w[mine] < load[hi] - load[lo]]
        if not len(fits):
            open_.discard(hi)
            continue
        best = fits[np.argmin(np.abs(2 * w[fits] - (load[hi] - load[lo])))]
        at[best] = lo
        load[hi] -= w[best]
        load[lo] += w[best]
    return out | {s: int(k) for s, k in zip(names, at, strict=True)}


def grown(shard_of: dict[Slot, int], weight: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """The next version with one shard more: slots move into the new shard only, from those with most, down to one level."""
    out, load, held = dict(shard_of), [0] * shards, [[] for _ in range(shards)]
    for slot in sorted(out, key=lambda s: (weight.get(s, 0), s)):
        load[out[slot]] += weight.get(slot, 0)
        held[out[slot]].append(slot)
    # the level of all shards afterwards; one whose largest slot is above it keeps what it has
    most = [max((weight.get(s, 0) for s in mine), default=0) for mine in held]
    giving = list(range(shards))
    level = sum(load) / (shards + 1)
    while len(giving) > len(giving := [k for k in giving if most[k] <= level]):
        level = sum(load[k] for k in giving) / (len(giving) + 1)
    new, heap = 0, [(-load[k], k) for k in giving]
    heapq.heapify(heap)
    while heap and new < level:
        n, k = heapq.heappop(heap)
        over = -n - level
        fits = [s for s in held[k] if 0 < weight.get(s, 0) <= min(level - new, 2 * over)]
        if not fits:
            continue  # this shard has no slot to give
        slot = min(fits, key=lambda s: (abs(weight[s] - over), s))
        held[k].remove(slot)
        out[slot], new = shards, new + weight[slot]
        heapq.heappush(heap, (n + weight[slot], k))
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: dict[Slot, int]) -> None:
    """Store one version of a map; a version is written once and never changed."""
    rows = [(slot, sub, shard) for (slot, sub), shard in sorted(shard_of.items())]
    spark.createDataFrame(rows, SHARD_MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> dict[Slot, int]:
    """One stored version; a row a slot."""
    return {(r["slot"], r["sub"]): r["shard"] for r in spark.read.schema(SHARD_MAP).parquet(f"{path}/version={version}").collect()}


def records(df: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS, carry: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, mark (a hash of the record), place (in the input) and home (its slot)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.select(F.col(doc).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit("record"), F.col(doc).cast("long"), F.col(text).cast("string")).alias("mark"), F.monotonically_increasing_id().alias("place"), *(F.col(c) for c in carry))
    return out.withColumn("home", F.pmod(F.xxhash64(F.lit("slot"), "mark"), F.lit(slots)).cast("int"))


def sharded(df: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, carry: tuple = ()) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot (its number in the shard), virtual_slot, sub_slot, map_version and ``carry``.

    The map is stored below ``map_path`` as version 0 (in turn) and version 1 (rebalanced by bytes).
    """
    spark = df.sparkSession
    rows = written(records(df, slots=slots, carry=carry), "records")
    sums = rows.groupBy("home").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row a slot: a fixed number
    if not sums:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.col("home").alias("virtual_slot"), F.lit(0).alias("sub_slot"), F.lit(1).alias("map_version"), F.lit(None).cast("int").alias("grown_shard"), *carry)
    total, count = sum(r["bytes"] for r in sums), sum(r["n"] for r in sums)
    parts = {r["home"]: parts_for(max(r["bytes"] / total, r["n"] / count) * shards, 1 / FINE) for r in sums if max(r["bytes"] / total, r["n"] / count) * shards > 1 / HOT}
    splits = F.broadcast(spark.createDataFrame(sorted(parts.items()), "home int, subs int"))  # at most 2 * HOT * shards slots are that large
    spread = F.xxhash64(F.lit("sub"), "mark", F.when(F.col("subs").isNotNull(), F.col("place")))
    dealt = rows.join(splits, "home", "left").withColumn("sub", F.coalesce(F.pmod(spread, "subs"), F.lit(0)).cast("int"))
    cells = max(1, count // (slots * CELL_ROWS))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), spread), F.lit(cells)).cast("int"))
    per_cell = written(dealt.groupBy(F.col("home").alias("slot"), "sub", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "cells")
    weight = {(r["slot"], r["sub"]): r["bytes"] for r in per_cell.groupBy("slot", "sub").agg(F.sum("bytes").alias("bytes")).collect()}  # slots and their bounded splits
    path = map_path or new_path(spark, "shard_map")
    first = even_map(sorted({(k, 0) for k in range(slots)} | set(weight)), shards)
    save_map(spark, path, 0, first)
    save_map(spark, path, 1, rebalanced(first, weight, shards))
    shard_map = F.broadcast(spark.read.schema(SHARD_MAP).parquet(f"{path}/version=1"))  # a row a slot
    before = Window.partitionBy("shard").orderBy("slot", "sub", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.join(shard_map, ["slot", "sub"]).select("shard", "sub", "cell", F.col("slot").alias("home"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("home", "sub", "cell").orderBy("mark", "doc_id", "size", "text_crc32", "place")
    numbered = dealt.withColumn("_nth", F.row_number().over(order)).join(offsets, ["home", "sub", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("_nth") - 1).cast("long").alias("slot"), F.col("home").alias("virtual_slot"), F.col("sub").alias("sub_slot"), F.lit(1).alias("map_version"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The records themselves as Parquet, one folder a shard, each in files of bounded numbers of rows."""
    carried = {c: f"_kept{i}" for i, c in enumerate(df.columns)}
    rows = sharded(df.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"`{c}`").alias(n) for c, n in carried.items())), shards, carry=tuple(carried.values()))
    out = rows.select(F.col("shard").alias("_shard"), "virtual_slot", "sub_slot", *(F.col(n).alias(c) for c, n in carried.items()))
    out.repartition("_shard", "virtual_slot", "sub_slot").drop("virtual_slot", "sub_slot").write.partitionBy("_shard").option("maxRecordsPerFile", 1_000_000).parquet(path)

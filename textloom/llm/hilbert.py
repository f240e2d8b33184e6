"""Approximate nearest neighbours along shifted Hilbert curves.

Each of several curves sees the vectors through its own random orthonormal
projection to a few dimensions, shifted by its own offset, and orders them by
Hilbert index.  Quantiles of the index cut a curve into ranges of equal
numbers of vectors (range partitions); a query searches its own range and the
neighbouring ones on either side.  Ranges are dealt to cells of bounded size
by hash, and a cell meets its queries in blocks, so one value that a third of
all vectors share makes more cells, not larger ones.  Each cell returns the
nearest few by exact distance; the cells' answers merge and rerank.

Every vector is on every curve.  ``reach`` ranges of ``ranges`` on either side
set the share of a curve that a query sees; with it recall is set, at a cost
in proportion to queries times rows.  A table with few vectors is cut into
fewer ranges, down to one, so that every query finds k.  On vectors without structure (64
dimensions, nearly uniform on a sphere) 0.9 needs the production values here.

Cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows whose dimension is not the most common one (the
larger of two as common) or whose id is null; rows that repeat an id count
once each as candidates but never for their own id; ties go to the smaller
id; fewer candidates than k give all; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import parts_for, written

CURVES, DIMENSIONS, BITS = 10, 5, 6
RANGES, REACH = 16, 1
NEIGHBOURS, EVERY = 10, 100
CELL, BLOCK = 8192, 65_536


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of whole-number points (rows), by the public transpose method."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def curve_frames(dim: int, curves: int = CURVES, dims: int = DIMENSIONS, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """Projections (curves, dim, dims) and shifts (curves, dims)."""
    rng = np.random.default_rng(seed)
    dims = min(dim, dims)
    frames = np.stack([np.linalg.qr(rng.normal(size=(dim, dims)))[0] for _ in range(curves)])
    return frames, rng.random((curves, dims))


def curve_keys(x: np.ndarray, frames: np.ndarray, shifts: np.ndarray, mean: np.ndarray, scale: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index of each row on each curve; coordinates span four deviations on either side."""
    out = np.zeros((len(frames), len(x)), np.int64)
    for c, (frame, shift) in enumerate(zip(frames, shifts, strict=True)):
        z = ((x - mean) @ frame) / scale[c]
        cell = np.floor(((z + 4) / 8 * 0.85 + shift * 0.15) * (1 << bits))
        out[c] = hilbert_index(np.clip(cell, 0, (1 << bits) - 1), bits)
    return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance) of each query's k nearest rows, its own id left out, ties to smaller ids."""
    q_out, r_out, d_out = [], [], []
    norms = (rows * rows).sum(1)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rough = norms[None] - 2 * (q @ rows.T) + (q * q).sum(1)[:, None]
        rough[query_ids[at : at + 256, None] == row_ids[None]] = np.inf
        slack = 1e-9 * (1 + norms.max())
        take = min(k, rough.shape[1])
        limit = np.partition(rough, take - 1, axis=1)[:, take - 1] + slack
        for i in range(len(q)):
            near = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
            exact = np.sqrt(((rows[near] - q[i]) ** 2).sum(1))
            order = np.lexsort((row_ids[near], exact))[:k]
            q_out.append(np.full(len(order), query_ids[at + i]))
            r_out.append(row_ids[near][order])
            d_out.append(exact[order])
    if not q_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(q_out), np.concatenate(r_out), np.concatenate(d_out)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their dimension (0: none)."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    return rows.filter(F.size("v") == dim), dim


RESULT = "query_id long, vec_id long, score double"


def neighbours(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, every: int = EVERY,
    curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS, ranges: int = RANGES, reach: int = REACH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows, dim = valid_vectors(df, vec_id, embedding)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    frames, shifts = curve_frames(dim, curves, dims)
    moments = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("s")).collect()
    mean = np.zeros(dim)
    spread = np.zeros(dim)
    for r in moments:  # one row a dimension
        mean[r["i"]], spread[r["i"]] = r["m"], r["s"]
    scale = np.sqrt(np.einsum("cij,i->cj", frames**2, spread)) + 1e-12

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            keys = curve_keys(x, frames, shifts, mean, scale, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(keys.T), pa.list_(pa.int64()))], names=["vec_id", "v", "keys"])

    keyed_rows = written(rows.mapInArrow(keyed, "vec_id long, v array<double>, keys array<long>"), "curves")
    # a range and the one below hold n / ranges rows at least: enough for k other ids, or there is one range
    repeats = keyed_rows.groupBy("vec_id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    ranges = max(1, min(ranges, repeats["n"] // ((k + 1) * repeats["most"])))
    curves = curves if ranges > 1 else 1  # one range of one curve is the whole table
    cuts = [i / ranges for i in range(1, ranges)] or [1.0]
    found = keyed_rows.agg(*(F.percentile_approx(F.col("keys")[c], cuts, 20_000).alias(f"c{c}") for c in range(curves))).first()
    edges = [sorted(set(found[c])) for c in range(curves)]

    def part_of(c: int):
        key = F.col("keys")[c]
        return F.size(F.filter(F.array(*map(F.lit, edges[c])), lambda edge: edge < key))

    numbered = keyed_rows.select("vec_id", "v", F.posexplode(F.array(*map(part_of, range(curves)))).alias("curve", "part"))
    counts = numbered.groupBy("curve", "part").count().collect()  # curves * ranges rows at most
    plan = spark.createDataFrame([(r[0], r[1], parts_for(r[2], CELL), parts_for(r[2] * (2 * reach + 1) / every, BLOCK)) for r in counts], "curve int, part int, cells int, blocks int")
    plan = F.broadcast(plan)  # curves * ranges rows at most
    data = numbered.join(plan, ["curve", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    data = data.select("curve", "part", F.pmod(F.xxhash64("vec_id"), "cells").cast("int").alias("cell"), "block", F.lit(0).alias("query"), "vec_id", "v")
    asked = numbered.filter(F.col("vec_id") % every == 0).withColumn("part", F.explode(F.sequence(F.col("part") - reach, F.col("part") + reach)))
    asked = asked.join(plan, ["curve", "part"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    asked = asked.select("curve", "part", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(1).alias("query"), "vec_id", "v")

    def search(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).combine_chunks()
        is_query, ids = np.asarray(table.column("query")) == 1, np.asarray(table.column("vec_id"))
        x = _matrix(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"), dim)
        if is_query.any() and not is_query.all():
            q, r, d = nearest(x[is_query], ids[is_query], x[~is_query], ids[~is_query], k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(d)], names=["query_id", "vec_id", "score"])

    merged = data.unionByName(asked).groupBy("curve", "part", "cell", "block").applyInArrow(search, RESULT)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = merged.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

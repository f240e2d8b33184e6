"""Hard negatives by a two-dimensional block matrix multiply.

Scores of anchors against all rows are a matrix product, computed on a grid:
anchors and rows are sharded into blocks, the dimensions into chunks, and a
panel holds one block's components of one chunk.  Every pair of panels of one
chunk gives a partial tile of int64 scores; the partial tiles of all chunks are
shuffled to their tile and added, and the tile keeps for each anchor what its
window can use, so no more than a few rows a tile go on.

Blocks are sharded by label first.  Positives need only tiles whose two blocks
may share a label, negatives need the others (and those, where several labels
share a bucket), so a tile is rarely computed twice.  A label that a third of
the rows hold has more blocks, not larger ones; blocks, panels and tiles have
bounded sizes, and a panel meets others by equality joins on the grid.

Scores are exact: whole components below 2^25 in float64 products where the sum
fits 53 bits, in int64 otherwise.

Cases: rows with a null label, null vector, or a null or non-finite component
take no part, nor do rows without vec_id, whose dimension is not the most common
one (the larger of two as common), or with a component of 2^17 or more in size,
whose products would not fit; zero vectors take part.  An id that repeats counts
as a row each time, but never as its own positive or negative; each different
anchor row of an id is an anchor, equal ones are one.  Ties go to the smaller
id.  A positive of negative score has an empty window.  Fewer positives or
negatives than asked for give all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import parts_for, small_batches, written

ANCHORS_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
SCALE = 256
#: the window: a negative has at least this percentage of the positive's score
LEAST_PERCENT = 80
#: rows of a block, anchors of a block, dimensions of a chunk (at most CHUNKS of them), buckets of labels
ROWS, ANCHORS, CHUNK, CHUNKS, BUCKETS = 2048, 64, 32, 8, 16
LIMIT = 1 << 25


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, label as changed and v of whole numbers; and their dimension (0: none)."""
    v, ident = F.col(embedding).cast("array<double>"), F.col(vec_id).cast("long")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT / SCALE))
    rows = df.filter(ident.isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~bad)
    own = F.col(label).cast("long")
    shifted = F.when(ident % RELABEL_EVERY == 0, (own + 1) % LABELS).otherwise(own)
    rows = rows.select(ident.alias("vec_id"), shifted.alias("label"), F.transform(v, lambda x: F.when(F.abs(x) < LIMIT / SCALE, F.floor(x * SCALE)).try_cast("int")).alias("v")).filter(F.size("v") > 0)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 0
    return rows.filter(F.size("v") == dim), dim


def chunks_of(dim: int) -> list[tuple[int, int]]:
    """(begin, length) of the dimension chunks."""
    n = min(CHUNKS, parts_for(dim, CHUNK))
    cuts = [dim * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ints(column: pa.Array, kind=np.int64) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), kind)


def panels(rows: DataFrame, side: str, cuts: list[tuple[int, int]], extra: tuple = ()) -> DataFrame:
    """The panels of rows (bucket, block, vec_id, label, mark, v and ``extra``), body as bytes; all else but body stands in chunk 0 only."""
    pieces = F.array(*(F.struct(F.lit(c).alias("chunk"), F.slice("v", a + 1, n).alias("v")) for c, (a, n) in enumerate(cuts)))
    kept = ["vec_id", "label", "mark", *extra]
    long = rows.select("bucket", "block", *kept, F.explode(pieces).alias("p")).select("bucket", "block", "p.chunk", *kept, "p.v")
    schema = f"{side}_bucket int, {side}_block int, chunk int, {side}_n int, {side}_body binary, " + ", ".join(f"{side}_{c} array<long>" if c != "window" else f"{side}_{c} array<array<long>>" for c in kept)
    names = [f.split()[0] for f in schema.split(", ")]

    def packed(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(groups)).combine_chunks()
        if not len(table):
            return
        # rows that tie in all of these are equal, so every chunk has one order
        table = table.sort_by([(c, "ascending") for c in ("vec_id", "label", "mark")])
        bucket, block, chunk = (table.column(c)[0].as_py() for c in ("bucket", "block", "chunk"))
        body = _ints(table.column("v").combine_chunks().flatten(), np.int32).tobytes()
        more = [pa.array([table.column(c).to_pylist() if chunk == 0 else None], pa.list_(pa.list_(pa.int64())) if c == "window" else pa.list_(pa.int64())) for c in kept]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(table)], pa.int32()), pa.array([body], pa.binary()), *more], names=names)

    return long.groupBy("bucket", "block", "chunk").applyInArrow(packed, schema)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 scores of the rows of a against those of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


KEYS = ("a_bucket", "a_block", "b_bucket", "b_block")


def tiles(a: DataFrame, b: DataFrame, grid: DataFrame, reduce, schema: str, a_extra: tuple = ()) -> DataFrame:
    """``reduce(scores, a columns, b columns)`` of every tile of ``grid``: partial tiles of each chunk, shuffled and added."""
    named = [*KEYS, "part", "a_n", "b_n", *(f"a_{e}" for e in ("vec_id", "label", "mark", *a_extra)), "b_vec_id", "b_label"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                sides = [np.frombuffer(row.column(at[f"{s}_body"])[0].as_buffer(), np.int32).reshape(row.column(at[f"{s}_n"])[0].as_py(), -1) for s in "ab"]
                part = pa.array([product(*sides).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([part if n == "part" else row.column(at[n]) for n in named], names=named)

    met = grid.join(a, ["a_bucket", "a_block"]).join(b, ["b_bucket", "b_block", "chunk"])
    lists = ", ".join(f"a_{e} array<long>" if e != "window" else "a_window array<array<long>>" for e in ("vec_id", "label", "mark", *a_extra))
    parts = met.mapInArrow(partial, f"a_bucket int, a_block int, b_bucket int, b_block int, part binary, a_n int, b_n int, {lists}, b_vec_id array<long>, b_label array<long>")

    def added(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, facts = None, {}
        for batch in groups:
            for i in range(len(batch)):
                row = {n: batch.column(batch.schema.get_field_index(n))[i] for n in named}
                part = np.frombuffer(row["part"].as_buffer(), np.int64).reshape(row["a_n"].as_py(), row["b_n"].as_py())
                scores = part if scores is None else scores + part
                if row["a_vec_id"].is_valid:
                    facts = {n: row[n].as_py() if n == "a_window" else np.asarray(row[n].values) for n in named[7:]}
        if scores is not None:
            yield from reduce(scores, facts)

    return parts.groupBy(*KEYS).applyInArrow(added, schema)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


POSITIVE = "anchor_id long, mark long, other long, score long"


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and each of its positives."""
    spark = df.sparkSession
    small_batches(spark, 8)  # a row that meets another holds two panels or a tile
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, dim = vectors(df, vec_id, embedding, label)
    if not dim:
        return spark.createDataFrame([], result)
    cuts = chunks_of(dim)
    rows = rows.withColumns({"mark": F.xxhash64("vec_id", "label", "v"), "bucket": F.pmod(F.xxhash64(F.lit("bucket"), "label"), F.lit(BUCKETS)).cast("int")})
    is_anchor = F.col("vec_id") % every == 0
    anchors = rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "v"])
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("m")).collect()  # BUCKETS rows at most
    many = F.broadcast(spark.createDataFrame([(r["bucket"], parts_for(r["n"], ROWS), parts_for(r["m"], ANCHORS)) for r in sizes], "bucket int, b_blocks int, a_blocks int"))
    spread = F.xxhash64(F.lit("block"), "mark", F.monotonically_increasing_id())  # a row that repeats is spread too
    b_rows = written(rows.join(many, "bucket").withColumn("block", F.pmod(spread, "b_blocks").cast("int")).drop("a_blocks", "b_blocks"), "rows")
    a_rows = written(anchors.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "mark"), F.col("a_blocks")).cast("int")).drop("a_blocks", "b_blocks"), "anchors")
    b = written(panels(b_rows, "b", cuts).drop("b_mark"), "row_panels")
    a = written(panels(a_rows, "a", cuts), "anchor_panels")
    columns = b.select("b_bucket", "b_block").distinct()

    def same_label(scores: np.ndarray, facts: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for i, (ident, mark, own) in enumerate(zip(facts["a_vec_id"], facts["a_mark"], facts["a_label"], strict=True)):
            near = np.flatnonzero((facts["b_label"] == own) & (facts["b_vec_id"] != ident))
            near = near[_first(scores[i, near], facts["b_vec_id"][near], positives)]
            out += [(ident, mark, facts["b_vec_id"][j], scores[i, j]) for j in near]
        yield _table(out, ["anchor_id", "mark", "other", "score"])

    met = a.select("a_bucket", "a_block").distinct().join(columns, F.col("a_bucket") == F.col("b_bucket"))
    best = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "other")
    found = tiles(a, b, met, same_label, POSITIVE).withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= positives)
    # an id that repeats with equal score is one window; each of its rows gives it again
    windows = written(found.filter("score >= 0").groupBy("anchor_id", "mark").agg(F.array_sort(F.collect_list(F.array("score", "other"))).alias("pairs")), "windows")  # ``positives`` each
    asked = a_rows.join(windows, (F.col("vec_id") == F.col("anchor_id")) & (a_rows["mark"] == windows["mark"])).select("bucket", "block", "vec_id", "label", a_rows["mark"], F.flatten("pairs").alias("window"), "v")
    a = written(panels(asked, "a", cuts, ("window",)), "window_panels")

    def other_label(scores: np.ndarray, facts: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for i, (ident, mark, own, window) in enumerate(zip(facts["a_vec_id"], facts["a_mark"], facts["a_label"], facts["a_window"], strict=True)):
            pairs = sorted({*zip(window[::2], window[1::2], strict=True)})
            top, low = pairs[-1][0], pairs[0][0]
            near = np.flatnonzero((facts["b_label"] != own) & (facts["b_vec_id"] != ident) & (scores[i] <= top) & (100 * scores[i] >= least_percent * low))
            near = near[np.lexsort((facts["b_vec_id"][near], -scores[i, near]))]
            down = -scores[i, near]
            for score, positive in pairs:
                begin = int(np.searchsorted(down, -score))
                for j in near[begin : begin + negatives]:
                    if 100 * scores[i, j] < least_percent * score:
                        break
                    out.append((ident, mark, positive, score, facts["b_vec_id"][j], scores[i, j]))
        yield _table(out, ["anchor_id", "mark", "positive_id", "positive_score", "negative_id", "negative_score"])

    cells = a.select("a_bucket", "a_block").distinct()
    alone = b_rows.groupBy("bucket").agg((F.min("label") == F.max("label")).alias("alone"))  # buckets of one label have no negatives in themselves
    grid = cells.join(alone, F.col("a_bucket") == F.col("bucket")).withColumn("b_bucket", F.explode(F.array(*(F.lit(r["bucket"]) for r in sizes))))
    grid = grid.filter(~F.col("alone") | (F.col("a_bucket") != F.col("b_bucket"))).select("a_bucket", "a_block", "b_bucket").join(columns, "b_bucket")
    hits = tiles(a, b, grid, other_label, "anchor_id long, mark long, positive_id long, positive_score long, negative_id long, negative_score long", ("window",))
    best = Window.partitionBy("anchor_id", "mark", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=names)

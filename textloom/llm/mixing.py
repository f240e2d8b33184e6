"""Mixing sources to target weights by balanced (cube) sampling.

Each document is to be taken target / source_size times on average.  The whole
part of that is certain; the fractional part is an inclusion probability that
the cube method decides so that token and document totals of a source stay
what they were.

Flight: within a group of documents of one source, three undecided documents
at a time move along the vector that leaves both totals unchanged (the null
space of a 2 x 3 matrix) until one of them reaches 0 or 1, so at most two are
left.  Groups are bounded: a source of any size is dealt to groups by hash,
what they leave is gathered into new groups, and so on, until one group a
source is left; each source gets there by its own size.  Ten of the documents of
that group, evenly spread by size, stay out of the flight;
the landing decides them with the at most two that the flight leaves, as the
subset of all 4096 at most with the least error in tokens and documents.

Cases: null or wordless text has size 0 and takes 0 words; a null source is a
source of its own, last in order; a null doc_id and repeated rows are units of
their own; sources without words have target 0; ties are broken by hash and
size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import WORD, parts_for, written

#: fixed values: weights in the order of the sources, repeating, and the most times a source is taken
WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 4096
LANDING = 10


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of all words by weight, held at ``most`` times the source."""
    named = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(named)}
    rest, open_, out = float(sum(size.values())), list(named), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * size[s])
        rest -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, leave: int = 0) -> np.ndarray:
    """Move probabilities to 0 or 1 with sums of p and of p * x unchanged; at most two stay between, and ``leave`` evenly spread ones."""
    p = p.copy()
    todo = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)).tolist()
    stay = set(np.linspace(0, len(todo) - 1, min(leave, len(todo))).astype(int).tolist())
    todo = [unit for turn, unit in enumerate(todo) if turn not in stay]
    draws = rng.random(len(todo) + 1)
    held: list[int] = []
    for turn, unit in enumerate(todo):
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u, strict=True) if v)
        step = up if draws[turn] * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            p[i] += step * v
        still = [i for i in held if 1e-9 < p[i] < 1 - 1e-9]
        for i in held:
            if i not in still:
                p[i] = round(p[i])
        held = still if len(still) < 3 else still[:2]
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the last few probabilities so that tokens, and then documents, are nearest to their totals."""
    p = p.copy()
    last = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(last):
        tries = np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1
        change = tries - p[last]
        error = np.abs(change @ x[last]) + np.abs(change.sum(1)) * max(1.0, x.mean()) / 50
        p[last] = tries[int(np.argmin(error))]
    return p


def _fly(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(groups))
    table = table.sort_by([("size", "descending"), ("rank", "ascending"), ("doc_id", "ascending")])
    p, x = np.asarray(table.column("p")), np.asarray(table.column("size")).astype(float)
    seed = int(np.asarray(table.column("rank"))[0]) & 0x7FFFFFFF
    last = np.asarray(table.column("groups"))[0] == 1
    p = flight(p, x, np.random.default_rng(seed), LANDING if last else 0)
    if last:
        p = landing(p, x)
    at = table.schema.get_field_index("p")
    yield from table.set_column(at, "p", pa.array(p)).to_batches()


def mixed(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: float = MOST, carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (size * copies) and the ``carry`` columns."""
    sized = written(
        df.select(
            F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(text).cast("string")).alias("mark"), *(F.col(c) for c in carry),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = totals.collect()  # one row a source; the join below is a broadcast only while their table is small
    aim = targets([(r["source"], r["source_size"]) for r in rows], weights, most)
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], aim[r["source"]], parts_for(r["n"], GROUP)) for r in rows], "source string, source_size long, target double, groups int"
    )
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.xxhash64(F.lit("mix"), "doc_id", "size", "mark", *carry)
    units = joined.withColumns({"sure": F.floor(rate + 1e-9), "rank": rank, "grp": F.pmod(F.xxhash64("rank"), "groups").cast("int")})
    units = units.withColumn("p", F.greatest(F.lit(0.0), rate - F.col("sure")))
    columns = ["doc_id", "source", "size", "source_size", "target", "sure", "rank", "grp", "groups", "p", *carry]
    units, most_groups, decided = units.select(*columns), max([r[3] for r in plan.collect()], default=1), []
    while True:
        moved = units.groupBy("source", "grp").applyInArrow(_fly, units.schema)
        if most_groups == 1:
            return _result([*decided, moved], carry)
        moved = written(moved, "flight")
        open_ = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
        decided.append(moved.filter(~open_))
        most_groups = parts_for(most_groups, GROUP // 2)
        units = moved.filter(open_).withColumn("groups", F.ceil(F.col("groups") / (GROUP // 2)).cast("int"))
        units = units.withColumn("grp", (F.col("grp") % F.col("groups")).cast("int"))


def _result(parts: list[DataFrame], carry: tuple) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    copies = (F.col("sure") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *carry)

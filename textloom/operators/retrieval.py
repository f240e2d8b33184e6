"""Retrieval and ranking: BM25, feature scores, weighted ranks with reasons, passage search, TF-IDF prediction."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import settled
from textloom.functions.text import words

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: (key, term, tf)."""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", carry: tuple = ()) -> DataFrame:
    """(key, the ``carry`` columns, bm25) of every document, 0 where no term meets; null for an empty query.

    Terms count once each.  Only postings of the query's terms are built, and
    collection statistics are one row, so the shuffle is as small as the matches.
    """
    terms = list(dict.fromkeys(query))
    if not terms:
        return docs.select(key, *carry, F.lit(None).cast("double").alias("bm25"))
    tokens = docs.select(key, *carry, words(F.col(text)).alias("tokens")).withColumn("len", F.size("tokens"))
    counts = {f"tf{i}": F.size(F.filter("tokens", _is(term))) for i, term in enumerate(terms)}
    table = tokens.select(key, *carry, "len", *(c.cast("double").alias(n) for n, c in counts.items()))
    table = settled(table)  # counts without texts, read twice
    stats = table.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(n) > 0).alias(f"d{n}") for n in counts))
    rows = table.crossJoin(F.broadcast(stats))  # one row

    def gain(n: str) -> Column:
        idf = F.log(1 + (F.col("n_docs") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        return idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))

    score = F.when(F.coalesce("avg_len", F.lit(0.0)) == 0, 0.0).otherwise(sum((gain(n) for n in counts), F.lit(0.0)))
    return rows.select(key, *carry, score.alias("bm25"))


def _is(term: str):
    return lambda x: x == term


@dataclass(frozen=True)
class Weights:
    """Weights of the ranking's features; refused when negative, unknown or all zero."""

    bm25: float = 0.45
    recency: float = 0.15
    source_type: float = 0.10
    peer_reviewed: float = 0.10
    open_access: float = 0.05
    citations: float = 0.10
    agreement: float = 0.05

    def __post_init__(self) -> None:
        values = [getattr(self, f.name) for f in fields(self)]
        if min(values) < 0 or not any(values):
            raise ValueError("weights must not be negative, nor all zero")

    @classmethod
    def parse(cls, config: dict) -> Weights:
        names = {f.name for f in fields(cls)}
        if set(config) != names:
            raise ValueError(f"unknown or missing weights: {sorted(set(config) ^ names)}")
        return cls(**config)


def recency(age_days: Column, window: Column | None = None, half_life: float = 90.0) -> Column:
    """Linear within a window of days, else halved every ``half_life`` days; null where there is no date."""
    age = F.greatest(age_days, F.lit(0))
    if window is not None:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age / window))
    return F.pow(F.lit(0.5), age / half_life)


def citation_score(count: Column, scholarly: Column, saturation: int = 1000) -> Column:
    return F.when(scholarly, F.least(F.lit(1.0), F.log1p(count) / math.log1p(saturation)))


def agreement(providers: Column, answered: Column) -> Column:
    return (providers - 1) / F.when(answered > 1, answered - 1)


#: fixed values: the order in which features with equal contributions are named
FEATURES = ("bm25", "recency", "source_type", "peer_reviewed", "open_access", "citations", "agreement")


def weighted(rows: DataFrame, weights: Weights, most: int = 4) -> DataFrame:
    """Adds score (unknown features count nothing) and why: the contributions above 0, largest first."""
    parts = {f: F.col(f) * getattr(weights, f) for f in FEATURES}
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0))
    named = F.array(*(F.struct((-F.round(p, 9)).alias("less"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, (f, p) in enumerate(parts.items())))
    why = F.slice(F.array_sort(F.filter(named, lambda x: x["less"] < 0)), 1, most)
    return rows.withColumns({"score": score, "why": F.array_join(F.transform(why, lambda x: x["name"]), ", ")})


def ranked(rows: DataFrame, n: int, *ties: Column) -> DataFrame:
    """The n best by score, then ties, numbered from 1."""
    top = rows.orderBy(F.desc("score"), *ties).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))  # n rows


def passage_matches(docs: DataFrame, passage: list[str], stop: set[str], share: float = 0.66, most: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with at least ceil(share * n) of the passage's n content words (``most`` at most)."""
    wanted = [w for w in dict.fromkeys(passage) if w not in stop][:most]
    need = math.ceil(share * len(wanted))
    found = F.size(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
    return docs.select(key, found.alias("found"), F.lit(need).alias("need")).filter("found >= need and need > 0")


def narrowing(results: DataFrame, query: list[str], most: int = 5) -> DataFrame:
    """Subjects that narrow a result list: two results at least, fewer than all that carry any, not all words in the query.

    ``results``: rank, subjects array.
    """
    one = results.select("rank", F.explode(F.array_distinct("subjects")).alias("subject"))
    carrying = results.agg(F.count_if(F.size("subjects") > 0).alias("carrying"))
    counts = one.groupBy("subject").agg(F.count("*").alias("results"), F.min("rank").alias("best_rank")).crossJoin(F.broadcast(carrying))  # one row
    fresh = F.size(F.array_except(words(F.col("subject")), F.array(*map(F.lit, query)).cast("array<string>"))) > 0
    return counts.filter((F.col("results") >= 2) & (F.col("results") < F.col("carrying")) & fresh).orderBy(F.desc("results"), "best_rank", "subject").limit(most).drop("carrying")


def field_bm25(docs: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], terms: tuple[str, ...], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows with a term: counts of each field weighed before they saturate, lengths over all fields, lower is better."""
    named = docs.select(key, *(c.alias(f"_{n}") for n, c in fields.items()))
    held = lambda field, term: F.size(F.filter(field, lambda x: x == term))
    counts = [sum((held(f"_{n}", t) * weights[n] for n in fields), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    length = sum((F.size(f"_{n}") for n in fields), F.lit(0))
    rows = named.select(key, *counts, length.alias("_len"))
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    norm = F.lit(k1) * (1 - b + b * F.col("_len") / F.col("_avg"))
    gain = lambda i: F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm)
    some = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    return rows.filter(some).crossJoin(F.broadcast(stats)).select(key, (-sum((gain(i) for i in range(len(terms))), F.lit(0.0))).alias("score"))  # one row


def ndcg(graded: DataFrame, group: str, k: int) -> DataFrame:
    """nDCG@k per group. ``graded``: group, rank, grade."""
    gain = lambda place: F.sum(F.when(place <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(place + 1)))
    ideal = graded.withColumn("ideal", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("grade"), "rank")))
    sums = ideal.groupBy(group).agg(gain(F.col("rank")).alias("got"), gain(F.col("ideal")).alias("best"))
    return sums.select(group, F.when(F.col("best") > 0, F.col("got") / F.col("best")).alias("ndcg"))


#: rows of a tile, and of a slice of it that is scored at once
TILE, SLICE = 1 << 14, 1 << 11
NEAREST = "q_id long, vec_id long, score double"


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, unit-free vectors and norms of (vec_id, v); a missing vector has norm -1."""
    table = table.sort_by("vec_id")
    lists = table.column("v").combine_chunks()
    missing = np.asarray(lists.is_null())
    flat, size = np.asarray(lists.drop_null().flatten(), np.float64), (~missing).sum()
    v = np.zeros((len(missing), len(flat) // max(1, size)))
    v[~missing] = flat.reshape(size, -1)
    return table.column("vec_id").to_numpy(), v, np.where(missing, -1.0, np.sqrt((v * v).sum(axis=1)))


def _nearest(k: int, digits: int):
    """Of a tile of rows and a block of queries, each query's k best: by rounded cosine, then by id.  A missing score comes last, one of a zero vector (not a number) first."""

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        (ids, v, norm), (q_ids, q, q_norm) = _vectors(rows), _vectors(asked)
        found = []
        for a in range(0, len(ids) if len(q_ids) else 0, SLICE):
            own, n = ids[a : a + SLICE], norm[a : a + SLICE]
            dots = q @ v[a : a + SLICE].T if q.shape[1] == v.shape[1] else np.zeros((len(q_ids), len(own)))
            with np.errstate(invalid="ignore", divide="ignore"):
                score = dots / (q_norm[:, None] * n)
            score = np.copysign(np.floor(np.abs(score) * 10**digits + 0.5) / 10**digits, score)
            rank = np.where(np.isnan(score), np.inf, score)
            rank[:, n < 0] = -2.0
            rank[q_norm < 0] = -2.0
            rank[q_ids[:, None] == own] = -3.0
            least = np.partition(rank, -k, axis=1)[:, -k, None] if len(own) > k else np.full((len(q_ids), 1), -2.0)
            i, j = np.nonzero((rank >= least) & (rank > -3.0))
            order = np.lexsort((j, -rank[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            found.append((i[place < k], own[j[place < k]], rank[i, j][place < k]))
        i, near, rank = (np.concatenate([x[c] for x in found]) if found else np.zeros(0) for c in range(3))
        order = np.lexsort((near, -rank, i))
        i, near, rank = i[order].astype(int), near[order], rank[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        rank = rank[best]
        score = pa.array(np.where(np.isinf(rank), np.nan, rank), mask=rank == -2.0)
        return pa.table({"q_id": pa.array(q_ids[i[best]], pa.int64()), "vec_id": pa.array(near[best], pa.int64()), "score": score})

    return nearest


def nearest_by_cosine(rows: DataFrame, asked: DataFrame, k: int, block: int, digits: int = 5) -> DataFrame:
    """(q_id, vec_id, score, rank): the k nearest other rows of each query by rounded cosine, ties to the smaller id; exact.

    ``rows``, ``asked``: vec_id, v.  Tiles of rows meet blocks of queries, and of
    each meeting only k rows a query go on, so what is shuffled does not grow as
    rows times queries, though the products do.
    """
    tiles, blocks = max(1, -(-rows.count() // TILE)), max(1, -(-asked.count() // block))
    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    every = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = every(dealt(rows, tiles, "tile"), blocks, "block"), every(dealt(asked, blocks, "block"), tiles, "tile")
    met = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(_nearest(k, digits), NEAREST)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

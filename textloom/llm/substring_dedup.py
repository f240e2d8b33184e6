"""Substring dedup by De Bruijn compaction of repeated token k-mers.

A window of ``k`` words is an edge of a De Bruijn graph whose nodes are the
runs of k-1 words at its ends.  The graph is compacted by minimizers, as in
published k-mer compactors: consecutive windows of a document that share a
minimizer (the least hash of their short word runs) are one path, named by its
minimizer and by the hash of all its words.

1. Paths: every path of every document becomes a row, packed in ranges of the
   minimizer and shuffled once.  A path whose words are also a path of a
   smaller document is a copy of that source coordinate.  A minimizer with one
   path only is nonbranching and settled; where several paths share a
   minimizer the graph branches, and the first bearer of each stays open.
2. Edges: open paths meet window by window in a second, smaller shuffle.
   Each copied window learns its source coordinate.
3. Spans: copied paths and windows join their documents; neighbours whose
   source coordinates continue each other are one span, so a long span is
   checked coordinate by coordinate, each under two independent 64-bit hashes
   (minimizer and content).  Covered words are dropped.

What many documents share is reduced before it is shuffled: a task forwards
one bearer of a path or window and settles the others itself, and a minimizer
with many paths in one task is spread over ranges of the content.

Cases: null or wordless text has no words and keeps the empty string; texts
shorter than k words lose nothing; rows with the same doc_id never remove
words from each other, nor does a row from itself; a null doc_id removes
nothing and loses nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.repeated import bucket_runs
from textloom.llm.shared import buckets_for, sized_filters, small_batches, text_bytes, written
from textloom.llm.wordbatch import U, Ranges, Words, int64_of, mix, slices, split_words, windows

WINDOW = 13
#: words of the short runs of which a window's minimizer is the least
RUN = 5
#: paths of one minimizer in one task from which they are dealt out by content
MANY = 8
#: rows that only pass through go in pieces of so many, each to a range of its own
PIECE = 1024
CONTENT = 0xC2B2AE3D27D4EB4F


def minimizers(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, minimizer, text) of every window of k words."""
    runs, at = windows(words, hashes, RUN)
    counts = np.maximum(words.counts() - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    run = start + np.repeat(np.searchsorted(at, words.first[:-1]), counts)
    width, least, span = k - RUN + 1, runs, 1
    while span * 2 <= width:  # least of 2, 4, 8 ... following runs
        least = np.minimum(least, np.concatenate((least[span:], least[-1:].repeat(span)))[: len(least)])
        span *= 2
    least = np.minimum(least[run], least[run + width - span])
    return start + np.repeat(words.first[:-1], counts), least, np.repeat(np.arange(len(counts)), counts)


def paths(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, ...]:
    """Per path: minimizer, content hash, first word, words, text."""
    first, least, text = minimizers(hashes, words, k)
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(0, U), none, none, none
    begin = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    start, end = first[begin], first[np.append(begin[1:], len(first)) - 1] + k
    return least[begin], Ranges(hashes, CONTENT).of(start, end), start, end - start, text[begin]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins, for sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _leaders(new: np.ndarray) -> np.ndarray:
    """For each row the index of its group's first row."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary"
SETTLED = "kind int, doc long, hash long, source long, source_at int"
NAMES = ["bucket", "kind", "a", "b", "c", "d"]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:2]), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[2:])], names=NAMES)


def _distinct_copies(doc: np.ndarray, content: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((source_at, source, content, doc))
    keep = order[_groups(doc[order], content[order])]
    return doc[keep], content[keep], source[keep], source_at[keep]


def _gather(k: int, buckets: int, chunk_bytes: int = 8 << 20):
    def flush(parts: list[tuple], turn: int) -> pa.RecordBatch | None:
        key, content, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, content, key))
        key, content, doc, at = key[order], content[order], doc[order], at[order]
        new = _groups(key, content)
        lead = _leaders(new)
        copy = doc > doc[lead]
        rows = []
        if copy.any():
            d, c, s, t = _distinct_copies(doc[copy], content[copy], doc[lead][copy], at[lead][copy])
            rows += [((turn + n // PIECE) % buckets, 2, c[n : n + PIECE], d[n : n + PIECE], s[n : n + PIECE], t[n : n + PIECE]) for n in range(0, len(c), PIECE)]
        key, content, doc, at = key[new], content[new], doc[new], at[new]
        begin = np.flatnonzero(_groups(key))
        number = np.diff(np.append(begin, len(key)))
        hot = np.repeat(number >= MANY, number)
        if hot.any():
            by = np.argsort(content[hot], kind="stable")
            h = [x[hot][by] for x in (key, content, doc, at)]
            rows += [(b, 1, *(x[s] for x in h)) for b, s in bucket_runs(h[1], buckets)]
            marker = begin[number >= MANY]  # one entry tells the others that this minimizer branches
            at = at.copy()
            at[marker] = -1
            keep = ~hot
            keep[marker] = True
            key, content, doc, at = key[keep], content[keep], doc[keep], at[keep]
        rows += [(b, 0, key[s], content[s], doc[s], at[s]) for b, s in bucket_runs(key, buckets)]
        return _pack(rows) if rows else None

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, turn = [], 0, TaskContext.get().partitionId() * 7919
        for batch in slices(batches, "text"):
            words = split_words(batch.column(1))
            docs = int64_of(batch.column(0))
            key, content, start, _, text = paths(words.hashes(), words, k)
            parts.append((key, content, docs[text], (start - words.first[text]).astype(np.int32)))
            held += batch.nbytes
            if held >= chunk_bytes:
                turn += 1
                if (out := flush(parts, turn)) is not None:
                    yield out
                parts, held = [], 0
        if parts and (out := flush(parts, turn)) is not None:
            yield out

    return gather


def _rows(kind: int, doc: np.ndarray, content: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(content.view(np.int64)), pa.array(source), pa.array(source_at.astype(np.int32))],
        names=["kind", "doc", "hash", "source", "source_at"],
    )


def _settle(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 1: a copied path and its source; kind 2: an open path, to be compared window by window."""
    held: dict[int, list] = {0: [], 1: []}
    for batch in groups:
        for _, kind, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if kind == 2:
                yield _rows(1, np.frombuffer(b, np.int64), np.frombuffer(a, U), np.frombuffer(c, np.int64), np.frombuffer(d, np.int32))
            else:
                held[kind].append((np.frombuffer(a, U), np.frombuffer(b, U), np.frombuffer(c, np.int64), np.frombuffer(d, np.int32)))
    for kind, parts in held.items():
        if not parts:
            continue
        key, content, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, content, key))
        key, content, doc, at = key[order], content[order], doc[order], at[order]
        mixed = np.zeros(len(key), bool)
        if kind == 0:
            begin = np.flatnonzero(_groups(key))
            size = np.diff(np.append(begin, len(key)))
            paths_of = np.add.reduceat(_groups(key, content).astype(np.int64), begin)
            told = np.logical_or.reduceat(at < 0, begin)
            mixed = np.repeat((paths_of > 1) | told, size)
            real = at >= 0
            key, content, doc, at, mixed = key[real], content[real], doc[real], at[real], mixed[real]
        else:
            mixed[:] = True
        new = _groups(key, content) if len(key) else np.zeros(0, bool)
        lead = _leaders(new)
        copy = doc > doc[lead] if len(lead) else new
        if copy.any():
            yield _rows(1, *_distinct_copies(doc[copy], content[copy], doc[lead][copy], at[lead][copy]))
        first = new & mixed
        if first.any():
            yield _rows(2, doc[first], content[first], doc[first], at[first])


EDGE = "edge long, least long, doc long, at int, source long, source_at int"


def _edges(k: int):
    """One row for each window of an open path and document; of equal windows here only the smallest document's stays open."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split_words(batch.column(1))
            docs = int64_of(batch.column(0))
            hashes = words.hashes()
            key, content, start, length, text = paths(hashes, words, k)
            wanted = _listed(batch.column(2), text, content)[0]
            key, start, number, text = key[wanted], start[wanted], length[wanted] - k + 1, text[wanted]
            if not len(start):
                continue
            first = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(start, number)
            least, text = np.repeat(key, number), np.repeat(text, number)
            edges, edge_at = windows(words, hashes, k)
            edge = edges[np.searchsorted(edge_at, first)]
            doc, at = docs[text], (first - words.first[text]).astype(np.int32)
            order = np.lexsort((at, doc, least, edge))
            edge, least, doc, at = edge[order], least[order], doc[order], at[order]
            once = _groups(edge, least, doc)
            edge, least, doc, at = edge[once], least[once], doc[once], at[once]
            lead = _leaders(_groups(edge, least))
            settled = doc > doc[lead]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(edge.view(np.int64)), pa.array(least.view(np.int64)), pa.array(doc), pa.array(at),
                    pa.array(np.where(settled, doc[lead], 0), mask=~settled), pa.array(np.where(settled, at[lead], 0).astype(np.int32), mask=~settled),
                ],
                names=["edge", "least", "doc", "at", "source", "source_at"],
            )

    return rows


def _listed(lists: pa.Array, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the list of their text, and where in the flattened lists."""
    flat = lists.flatten()
    values = np.asarray(flat.field("hash") if pa.types.is_struct(flat.type) else flat).view(U)
    offsets = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    have, want = mix(values + owner.astype(U) * U(CONTENT)), mix(hashes + text.astype(U) * U(CONTENT))
    order = np.argsort(have, kind="stable")
    if not len(have):
        return np.zeros(len(want), bool), np.zeros(len(want), np.int64)
    at = order[np.minimum(np.searchsorted(have[order], want), len(have) - 1)]
    return have[at] == want, at


def copies(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(kind, doc, hash, source, source_at): copied paths (1) and windows (3) of ``docs`` (doc, text), doc not null."""
    buckets = buckets_for(docs, text_bytes(docs), 4 << 20)
    found = written(docs.mapInArrow(_gather(k, buckets), PACKED).groupBy("bucket").applyInArrow(_settle, SETTLED), "paths")
    open_ = written(found.filter("kind = 2").groupBy("doc").agg(F.collect_set("hash").alias("open")), "open").filter("doc is not null")
    with sized_filters(docs.sparkSession):
        edges = docs.join(open_, "doc").select("doc", "text", "open").mapInArrow(_edges(k), EDGE)
        # settled rows need no answer; a number of their own spreads them
        spread = F.when(F.col("source").isNull(), F.col("edge")).otherwise(F.xxhash64("doc", "at"))
        first = F.min(F.struct("doc", "at")).over(Window.partitionBy("spread", "edge", "least"))
        known = edges.withColumn("spread", spread).withColumn("first", F.when(F.col("source").isNull(), first))
        known = known.select(F.lit(3).alias("kind"), "doc", F.col("edge").alias("hash"), F.coalesce("source", "first.doc").alias("source"), F.coalesce("source_at", "first.at").alias("source_at"))
        windows_ = written(known.filter("source < doc"), "edges")
    return found.filter("kind = 1").unionByName(windows_)


SPAN = "array<struct<start:int,words:int,source:bigint,source_start:int>>"


def _cut(k: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))

    def covered(words: Words, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Copied stretches: first word, words, source, source's first word, text; by first word."""
        hashes, out = words.hashes(), []
        for column, kind in ((batch.column(2), 1), (batch.column(3), 3)):
            flat = column.flatten()
            if not len(flat):
                continue
            if kind == 1:
                _, h, start, length, text = paths(hashes, words, k)
            else:
                h, start = windows(words, hashes, k)
                text = np.searchsorted(words.first, start, side="right") - 1
                length = np.full(len(start), k)
            hit, at = _listed(column, text, h)
            source, source_at = np.asarray(flat.field("source")), np.asarray(flat.field("source_at"))
            out.append((start[hit], length[hit], source[at[hit]], source_at[at[hit]].astype(np.int64), text[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 5
        every = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.lexsort((-every[1], every[0]))
        return tuple(x[order] for x in every)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split_words(batch.column(1))
            raw = words.data.tobytes()
            n, first = words.counts(), words.first
            start, length, source, source_at, text = covered(words, batch)
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
            # a stretch that continues the one before it, in its document and in its source, is part of the same span
            reach = np.maximum.accumulate(start + length) if len(start) else start
            new = np.ones(len(start), bool)
            shift = source_at - (start - first[text])
            new[1:] = (start[1:] > reach[:-1]) | (text[1:] != text[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
            begin = np.flatnonzero(new)
            end = np.maximum.reduceat(start + length, begin) if len(begin) else start
            lists: list[list] = [[] for _ in range(batch.num_rows)]
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                lists[text[b]].append({"start": int(start[b] - first[text[b]]), "words": int(e - start[b]), "source": int(source[b]), "source_start": int(source_at[b])})
            kept = []
            for i in range(batch.num_rows):
                stay = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                kept.append(b" ".join([raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string()), pa.array(lists, span)],
                names=["doc", "n_words", "n_removed", "kept_text", "spans"],
            )

    return cut


def substring_dedup(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text and the spans that were cut, with their sources."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    found = copies(docs.filter("doc is not null and text is not null"), k)
    one = F.struct("hash", "source", "source_at")
    lists = found.groupBy("doc").agg(F.collect_list(F.when(F.col("kind") == 1, one)).alias("paths"), F.collect_list(F.when(F.col("kind") == 3, one)).alias("windows"))
    none = F.array().cast("array<struct<hash:bigint,source:bigint,source_at:int>>")
    out = docs.join(lists, "doc", "left").select("doc", "text", F.coalesce("paths", none).alias("paths"), F.coalesce("windows", none).alias("windows"))
    out = out.mapInArrow(_cut(k), f"doc long, n_words long, n_removed long, kept_text string, spans {SPAN}")
    return out.withColumnRenamed("doc", "doc_id")

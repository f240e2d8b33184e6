"""Which 64-bit keys occur under two or more ids, over any number of rows.

Each task gathers the keys of some megabytes of text, keeps one entry for a
key and settles locally which keys have several ids there.  Only one entry
for a key and chunk is shuffled, packed by ranges of the key, so a key that a
third of all rows hold reaches its reducer once a chunk and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textloom.llm.wordbatch import U, slices

#: kind 0: entries to be compared; 1: ids of a key that are known to be several; from 2: rows that pass through.
PACKED = "bucket int, kind int, keys binary, ids binary, sizes binary, marks binary"
PIECE = 2048
ROWS = "kind int, key long, id long, size int, mark binary"


def bucket_runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets (ranges of equal width) that sorted keys fall into, and where their keys lie; empty ones cost nothing."""
    of = ((keys >> U(32)) * U(buckets)) >> U(32)
    begin = _runs(of)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
        yield int(of[a]), slice(a, b)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def several(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by key, and a mask of those whose key has several ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    begins = _runs(keys)
    counts = np.diff(np.append(begins, len(keys)))
    return keys, ids, np.repeat(counts > 1, counts)


def _joined(marks: list[bytes]) -> bytes:
    return np.array([len(m) for m in marks], np.int32).tobytes() + b"".join(marks)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
        names=["bucket", "kind", "keys", "ids", "sizes", "marks"],
    )


def repeated_keys(
    df: DataFrame, text: str, entries: Callable, buckets: int, chunk_bytes: int = 8 << 20
) -> DataFrame:
    """Rows (kind 1, key, id) of each key with two or more ids, and the rows that ``entries`` passes through (kind 2 on).

    ``entries(batch)`` gives (keys, ids, passed): 64-bit keys, signed ids and a
    list of (kind, keys, ids, sizes, marks): arrays, and a list of bytes.  An id that holds a key twice counts
    once.  A key may be returned under one id several times.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held, turn = [], [], 0, TaskContext.get().partitionId() * 7919

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            k, i, many = several(np.concatenate(keys), np.concatenate(ids))
            rows = []
            known = [x[many] for x in (k, i)]
            for n in range(0, len(known[0]), PIECE):
                rows.append((turn % buckets, 1, *(x[n : n + PIECE].tobytes() for x in known), b"", b""))
                turn += 1
            first = _runs(k)
            k, i = k[first], i[first]
            for b, s in bucket_runs(k, buckets):
                rows.append((b, 0, k[s].tobytes(), i[s].tobytes(), b"", b""))
            if rows:
                yield _packed(rows)

        for batch in slices(batches, text):
            k, i, passed = entries(batch)
            if passed:
                turn += 1
                yield _packed([(turn % buckets, kind, a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), _joined(marks)) for kind, a, b, n, marks in passed])
            keys.append(k)
            ids.append(i)
            held += batch.nbytes
            if held >= chunk_bytes:
                yield from flush()
                keys, ids, held = [], [], 0
        if keys:
            yield from flush()

    def settle(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in groups:
            for kind, k, i, n, m in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True):
                if kind == 0:
                    keys.append(np.frombuffer(k, U))
                    ids.append(np.frombuffer(i, np.int64))
                else:
                    k = np.frombuffer(k, np.int64)
                    yield _plain(kind, k, np.frombuffer(i, np.int64), np.frombuffer(n, np.int32) if n else np.zeros(len(k), np.int32), m)
        if keys:
            k, i, many = several(np.concatenate(keys), np.concatenate(ids))
            if many.any():
                yield _plain(1, k[many].view(np.int64), i[many], np.zeros(int(many.sum()), np.int32))

    packed = df.mapInArrow(gather, PACKED)
    return packed.groupBy("bucket").applyInArrow(settle, ROWS)


def _plain(kind: int, k: np.ndarray, i: np.ndarray, n: np.ndarray, marks: bytes = b"") -> pa.RecordBatch:
    mark = pa.nulls(len(k), pa.binary())
    if marks:
        ends = np.frombuffer(marks, np.int32, len(k)).cumsum() + 4 * len(k)
        mark = pa.array([marks[a:b] for a, b in zip(np.append(4 * len(k), ends[:-1]), ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(i), pa.array(n), mark],
        names=["kind", "key", "id", "size", "mark"],
    )

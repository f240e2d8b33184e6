"""Vectorised words, hashes and word windows of Arrow text columns.

Words are maximal runs of bytes other than space and 09-0D.  In UTF-8 these
separators never occur inside a longer sequence, so bytes suffice and code
points need no decoding.  A word is hashed eight bytes at a time with a
non-linear mix between them; ranges of words by two polynomials over the field
of 2**31 - 1, whose prefix sums give the hash of any range in O(1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_M = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_Q = {0: 0xBF58476D1CE4E5B9, 1: 0x94D049BB133111EB}
PRIME = (1 << 31) - 1
#: bytes of a word from which it is hashed by itself
LONG_WORD = 256
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x below 2**62."""
    p = U(PRIME)
    x = (x & p) + (x >> U(31))
    x = (x & p) + (x >> U(31))
    return np.where(x >= p, x - p, x)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (int(n) - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(1, U)
            while len(p) < size:
                p = np.concatenate((p, _mod(p * U(pow(b, len(p), PRIME)))))
            both.append(p)
        have = _POWERS[base] = tuple(both)
    return have[0][:n], have[1][:n]


class Ranges:
    """Hash of any range of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, base: int):
        n, self.halves = len(values), []
        for salt in (0, 1):
            b = base * (2 * salt + 1) % (PRIME - 3) + 2
            sums = np.zeros(n + 1, U)
            np.cumsum(_mod(_mod(values >> U(1 + 31 * salt) & U(PRIME)) * _powers(b, n)[0]), out=sums[1:], dtype=U)
            self.halves.append((b, sums))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_mod(_mod(sums[end] - sums[start]) * _powers(b, len(sums))[1][start]) for b, sums in self.halves)
        return mix((high << U(31) | low) + (end - start).astype(U) * U(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data`` and the text of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: words before text i; one more entry than texts

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A hash of each word's bytes and length."""
        data = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        length, seed = self.end - self.start, U(_M[family])
        out = np.full(len(length), seed, U)
        todo, at = np.flatnonzero(length < LONG_WORD), 0
        while len(todo):
            chunk = eight[self.start[todo] + at] & _MASK[np.minimum(length[todo] - at, 8)]
            out[todo] = mix(out[todo] ^ chunk)
            at += 8
            todo = todo[length[todo] > at]
        for i in np.flatnonzero(length >= LONG_WORD):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=bytes([family])).digest(), "little")
        return mix(out + length.astype(U) * seed)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, off = text_arrays(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    sep = _SEP[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:], after[:-1] = sep[:-1], sep[1:]
        begins = off[:-1]
        before[begins[begins < n]] = True
        after[off[1:][off[1:] > 0] - 1] = True
    start = np.flatnonzero(~sep & before)
    end = np.flatnonzero(~sep & after) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def windows(words: Words, hashes: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words that lies in one text, and the word it starts at."""
    counts = np.maximum(words.counts() - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ahead = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts)
    at = np.arange(total) + ahead
    return Ranges(hashes, _Q[family]).of(at, at + k), at


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        off = text_arrays(batch.column(at))[1]
        begin = 0
        while begin < batch.num_rows:
            stop = int(np.searchsorted(off, off[begin] + limit, side="right")) - 1
            stop = min(max(stop, begin + 1), batch.num_rows)
            yield batch.slice(begin, stop - begin)
            begin = stop
        del batch, off
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


def int64_of(column: pa.Array, null: int = 0) -> np.ndarray:
    """Whole numbers of an Arrow column; ``null`` where it has none."""
    return np.asarray(column.cast(pa.int64()).fill_null(null))

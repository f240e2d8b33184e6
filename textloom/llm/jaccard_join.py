"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles.  Shingles are dealt
to ``m`` blocks by their hash and each block keeps the parity (XOR) of its
shingles' marks, a bit sketch whose Hamming distance, in blocks, is at most
the symmetric difference of the sets.  Sets A, B with Jaccard >= t differ in
at most ``(1-t)/(1+t) * (|A|+|B|)`` shingles.

1. Sketches meet by (size band, block, parity).  A band's sets have more
   occupied blocks than they may differ in, so similar sets agree in one at
   least (pigeonhole), and in all but the difference: a set with fewer shared
   blocks than that has no partner and is done.  A document whose size admits
   partners of the next band is also entered there.  A set with too few
   occupied blocks enters each shingle by itself, which loses nothing.
2. The few sets left meet by their rarest shingles.  Of A and B with c common
   shingles at least, one of the ``|A| - c + 1`` rarest of A is one of the
   ``|B| - c + 1`` rarest of B.  Of each shingle the set that shares most
   stands for it; the others are first compared with that one alone, by wide
   parity sketches and then word by word.
3. Shingles whose sets are in different components afterwards join by the
   sizes and ranks that the bound leaves, and are verified likewise.

Equal sets are one node throughout, so exact copies cost nothing.

Cases: null or wordless texts have no shingles, link with nothing, and are
their own component; fewer than k words are one shingle, the whole sequence;
repeated rows and copies fall into one component; ties go to the smaller
doc_id; rows with a null doc_id link others but never name a component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.repeated import bucket_runs, repeated_keys
from textloom.llm.shared import buckets_for, sized_filters, small_batches, text_bytes, written
from textloom.llm.wordbatch import U, Ranges, int64_of, mix, slices, split_words, windows

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
NO_ID = -(1 << 63)
#: a set enters by (band, kind) of key: its own band or the next, blocks or shingles
ENTRIES = 4
#: sizes in one bucket of the last join differ by this factor at most
WIDTH = 1.02


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split_words(column, lower=True)
    hashes = words.hashes()
    shingles, at = windows(words, hashes, k)
    first = np.searchsorted(at, words.first)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = Ranges(hashes, 0x94D049BB133111EB).of(words.first[short], words.first[short + 1]) if len(short) else []
    out = [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i, h in zip(short, whole, strict=True):
        out[i] = np.array([h], U)
    return out


def set_id(shingles: np.ndarray) -> int:
    """62 bits that name a set, above room for its entry: the mixed sum of its members, with its size."""
    total = mix(shingles + U(0x632BE59BD9B4E019)).sum(dtype=U) + U(len(shingles))
    return int(mix(np.array([total]))[0].view(np.int64)) // ENTRIES * ENTRIES


def band_of(n: int) -> int:
    """Sizes 1, 2, 3-4, 5-8, ...: band b holds sizes up to 2**b."""
    return (n - 1).bit_length()


def blocks_in(band: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Blocks of a band: half as many again as the largest possible difference."""
    return 2 + 3 * (1 << band) * (den - num) // (den + num)


def block_numbers(shingles: np.ndarray, m: int) -> np.ndarray:
    return ((shingles >> U(32)) * U(m)) >> U(32)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits, one flipped by each shingle: 512, then as many as twice the set's size needs (a power of 2).

    Two sketches of one width differ in at most as many bits as the sets do in members; a wider one folds to a narrower.
    """
    width = max(512, 1 << (2 * max(1, len(shingles)) - 1).bit_length())
    bits = (np.bincount((mix(shingles) & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1, 512).sum(0) & 1).tobytes() + np.packbits(bits).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which the wide parts of two sketches differ, at the narrower one's width."""
    x, y = np.frombuffer(a, np.uint8)[64:], np.frombuffer(b, np.uint8)[64:]
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def join_keys(shingles: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, np.ndarray, int]]:
    """(entry, keys, need): two sets with Jaccard >= num/den share a key, and each has ``need`` keys in common with the other under an entry that both have."""
    n = len(shingles)
    own = band_of(n)
    largest = n * den // num
    out = []
    marks = mix(shingles ^ U(0x5851F42D4C957F2D))
    for turn, band in enumerate(range(own, band_of(largest) + 1)):
        block = block_numbers(shingles, blocks_in(band, num, den))
        begins = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        differ = (n + min(largest, 1 << band)) * (den - num) // (den + num)
        salt = U(0x2545F4914F6CDD1D * (band + 1) & (1 << 64) - 1)
        parity = np.bitwise_xor.reduceat(marks, begins)
        out.append((2 * turn, mix(parity ^ (block[begins] * U(0x9E3779B97F4A7C15) + salt)), max(1, len(begins) - differ)))
        if len(begins) <= differ:
            out.append((2 * turn + 1, mix(marks ^ mix(np.array([salt]))), n - differ))
    return out


def _entries(k: int, num: int, den: int):
    """Sketch keys of (doc, text_hash, text); kind 2: each document's set, kind 3: how many shared keys each entry of a set needs."""

    def entries(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(2), k)
        docs = int64_of(batch.column(0), NO_ID)
        sizes = np.array([len(s) for s in sets], np.int32)
        names = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
        every = [(i + entry, keys, need) for i, s in zip(names.tolist(), sets, strict=True) if len(s) for entry, keys, need in join_keys(s, num, den)]
        ids, needs = (np.array([e[i] for e in every], np.int64) for i in (0, 2))
        raw = int64_of(batch.column(1)).astype(">i8").tobytes()
        marks = [raw[i : i + 8] for i in range(0, len(raw), 8)]
        keys = np.concatenate([e[1] for e in every]) if every else np.zeros(0, U)
        return keys, np.repeat(ids, [len(e[1]) for e in every]), [(2, names, docs, sizes, marks), (3, ids, needs, np.zeros(len(ids)), [b""] * len(ids))]

    return entries


ALIVE = "sid long, size int, mark binary, text string"


def _texts(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(sid, size, mark, text) of every wanted set (sid, size, doc, text_hash), from a document that has it; mark: its wide sketch."""
    id_of = F.coalesce("doc", F.lit(NO_ID))
    want = wanted.filter("size > 0").select("sid", "size", id_of.alias("id"), "text_hash")  # filtered, so that Spark builds its Bloom filter of it
    joined = docs.select(id_of.alias("id"), "text_hash", "text").join(want, ["id", "text_hash"]).select("sid", "size", "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = shingle_sets(batch.column(2), k)
            same = [len(s) == n and set_id(s) == i for s, i, n in zip(found, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            marks = pa.array([sketch(s) if ok else None for s, ok in zip(found, same, strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, batch.column(2)], names=["sid", "size", "mark", "text"])
            yield out.filter(pa.array(same, pa.bool_()))

    return joined.mapInArrow(keep, ALIVE).dropDuplicates(["sid"])


def word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as the words themselves."""
    words = split_words(pa.array([text]), lower=True)
    raw = words.data.tobytes()
    w = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def _verified(pairs: DataFrame, alive: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard >= num/den: by the wide sketches' bound, then counted on all words."""
    marks = alive.select("sid", "size", "mark")
    x = marks.select(F.col("sid").alias("a"), F.col("size").alias("n"), F.col("mark").alias("x"))
    y = marks.select(F.col("sid").alias("b"), F.col("size").alias("m"), F.col("mark").alias("y"))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            good = [apart(p, q) * (den + num) <= (i + j) * (den - num) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    near = written(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(wide, "a long, b long"), "near")
    left = alive.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    right = alive.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    both = near.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if den * shared >= num * (len(x) + len(y) - shared):
                    one, two = (word_shingles(batch.column(c)[i].as_py(), k) for c in (2, 3))
                    good[i] = den * len(one & two) >= num * len(one | two)
            yield batch.select([0, 1]).filter(pa.array(good))

    with sized_filters(alive.sparkSession):
        return written(both.mapInArrow(count, "a long, b long"), "links")


def _left(of: Column, partner: Column, num: int, den: int) -> Column:
    """How many shingles a set of size ``of`` can have besides those of a similar partner, times num + den."""
    return of * den - partner * num


COUNTS = "bucket int, chunk int, keys binary, counts binary"
RARE = "key long, sid long, size int, place int, lone int"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "chunk", "keys", "counts"])


def _rarest(alive: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, sid, size, place, lone): the shingles that a partner may have as its first common one, rarest first.

    place: how many rarer ones the set has; lone: how many of its shingles no other set has.
    The sets are dealt to chunks; a chunk sends each of its shingles once, with
    the number of its sets, and gets the sum over all chunks back.
    """
    chunks = buckets_for(alive, text_bytes(alive), 8 << 20)
    dealt = alive.select(F.pmod(F.xxhash64("sid"), F.lit(chunks)).cast("int").alias("chunk"), "sid", "text")

    def count(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, chunk = [np.zeros(0, U)], 0
        for batch in slices(groups, "text"):
            chunk = batch.column(0)[0].as_py()
            keys += shingle_sets(batch.column(2), k)
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        yield _rows([(b, chunk, found[at].tobytes(), counts[at].astype(np.uint32).tobytes()) for b, at in bucket_runs(found, chunks)])

    def total(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [row for batch in groups for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        keys = [np.frombuffer(p[2], U) for p in parts]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([np.frombuffer(p[3], np.uint32) for p in parts]), minlength=len(every)).astype(np.int64)
        yield _rows([(p[0], p[1], b"", sums[np.searchsorted(every, own)].tobytes()) for p, own in zip(parts, keys, strict=True)])

    def rank(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = list(slices(iter(texts.to_batches()), "text"))
        sets = [s for p in pieces for s in shingle_sets(p.column(2), k)]
        sids = [i for p in pieces for i in p.column(1).to_pylist()]
        keys = np.unique(np.concatenate([np.zeros(0, U), *sets]))
        bodies = answers.column("counts").to_pylist()
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(bodies[i], np.int64) for i in np.argsort(np.asarray(answers.column("bucket"))))])
        out = []
        for sid, s in zip(sids, sets, strict=True):
            bearers, n = numbers[np.searchsorted(keys, s)], len(s)
            lone = int((bearers == 1).sum())
            stop = (n * den - -(-n * num // den) * num) // (den + num) + 1
            place = np.lexsort((s, bearers))[lone:stop]
            out.append((s[place].view(np.int64), np.full(len(place), sid), np.full(len(place), n), lone + np.arange(len(place)), np.full(len(place), lone)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({name: pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, (name, c) in enumerate(zip(("key", "sid", "size", "place", "lone"), cols, strict=True))})

    counted = dealt.groupBy("chunk").applyInArrow(count, COUNTS).groupBy("bucket").applyInArrow(total, COUNTS)
    return written(dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(rank, RARE), "rarest")


def _bucket(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(WIDTH))).cast("int")


def _rest(rare: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of different components whose first common shingle may be one that both have here, a no larger than b."""
    placed = rare.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    open_ = written(placed.join(mixed, "key"), "open")
    size, all_ = F.col("size"), den + num
    small = open_.filter(F.col("place") * all_ <= _left(size, size, num, den)).withColumn("bucket", _bucket(size))
    low = F.ceil(size * num / den)
    high = F.least(size, F.floor((size * den - F.col("place") * all_) / num))
    large = open_.filter(low <= high).withColumn("bucket", F.explode(F.sequence(_bucket(low), _bucket(high))))
    x, y = small.alias("x"), large.alias("y")
    n, m = F.col("x.size"), F.col("y.size")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label"))
    order = (n < m) | ((n == m) & (F.col("x.sid") < F.col("y.sid")))
    fits = (F.col("x.place") * all_ <= _left(n, m, num, den)) & (F.col("y.place") * all_ <= _left(m, n, num, den))
    return x.join(y, meet & order & fits).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def jaccard_components(
    df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """One row per document: doc, n_shingles, component_id (the smallest doc that links reach, itself included)."""
    return jaccard_groups(df, doc, text, k, num, den).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(
    df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """``jaccard_components`` with text_hash (xxhash64 of the text) and grp, which names the component also where no row of it has a doc (null without words)."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    docs = docs.select("doc", F.xxhash64("text").alias("text_hash"), "text")
    buckets = buckets_for(docs, text_bytes(docs), 2 << 20)
    found = written(repeated_keys(docs, "text", _entries(k, num, den), buckets), "keys")
    every = found.filter("kind = 2").select(
        F.col("key").alias("sid"), F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias("doc"), "size", F.conv(F.hex("mark"), 16, -10).cast("long").alias("text_hash")
    )
    shared = found.filter("kind = 1").groupBy("id").agg(F.count_distinct("key").alias("shared"))
    need = found.filter("kind = 3").groupBy("key").agg(F.min("id").alias("need"))
    met = shared.join(need, F.col("id") == F.col("key")).filter("shared >= need").select((F.col("id") - F.pmod("id", F.lit(ENTRIES))).alias("sid")).distinct()
    # of each set the document with the least doc_id, one without doc_id only where there is no other
    bearer = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash"))
    sets = every.filter("size > 0").groupBy("sid", "size").agg(bearer.alias("by"), F.min("doc").alias("doc"))
    wanted = written(sets.join(met, "sid").select("sid", "size", F.col("by.doc").alias("doc"), F.col("by.text_hash").alias("text_hash")), "wanted")
    with sized_filters(docs.sparkSession):
        alive = written(_texts(wanted, docs, k), "alive")

    rare = _rarest(alive, k, num, den)
    lead = rare.groupBy("key").agg(F.min_by("sid", F.struct(F.col("lone") / F.col("size"), "sid")).alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    ratio = (F.col("size") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("size") * num)
    stars = rare.join(lead, "key").filter("sid <> a").select("a", F.col("sid").alias("b"), "size").distinct()
    stars = stars.join(alive.select(F.col("sid").alias("a"), F.col("size").alias("m")), "a").filter(ratio).select("a", "b")
    links = _verified(stars, alive, k, num, den)
    labels = written(components(links), "labels")
    more = _verified(_rest(rare, labels, num, den), alive, k, num, den)
    if more.limit(1).count():
        labels = written(components(links.union(more)), "labels")

    named = sets.join(labels, sets["sid"] == labels["node"], "left").select("sid", "size", "doc", F.coalesce("label", "sid").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    names = named.join(least, "label").select("sid", "size", "component_id", F.col("label").alias("grp"))
    out = every.join(names, ["sid", "size"], "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        "text_hash", "grp",
    )

"""Source divergence audit: how the word use of each source differs from that of others and of its language.

Two passes over the texts.  The first merges count-min sketches of document
frequencies: each task adds, for every document, one to the cells of each of
its terms; merged cells are sums that stop at the threshold.  A cell never
underestimates, so a term with a cell below the threshold is surely too rare.
The second pass counts terms by language and source and drops such impossible
terms before anything is shuffled.  What survives is counted exactly, and terms
that are rare after all go then, so collisions cost work and never change a
result.

Pairs of sources are joined sparsely.  Sums over all kept terms are split: for
terms of one source of the pair alone the other's p is that of count 0, so
their values depend on the count only and come from a table of how many terms
have each count; for terms that neither has, the value is one constant; and
only terms that both have are joined.

All arithmetic is on whole numbers: counts times 10^9 as decimals, the rest in
64 bits.

Cases: a row is a document, whatever its id, so repeated rows count again; null
text, lang and source are ''; documents without terms still make their group
occur; a language without kept terms has pairs of value 0 and no terms; a
language of one source has no pairs; ties of values go to the item that is
smaller by UTF-8 bytes; long texts are cut into pieces at term ends; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import small_batches, written

#: a term is kept from this many documents of its language on
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: cells of one row of the sketch, and its rows; 2 MiB together
CELLS, ROWS = 1 << 20, 2
BLOCKS = 64
#: terms that a task holds before it hands them on
HELD = 500_000
#: rows of an Arrow batch
STEP = 50_000
PIECE = 1 << 20

#: what belongs to a term stays, A-Z become small, all other ASCII becomes a space
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length, cut between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(LETTERS)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # one term longer than a piece
                part += text[end : end + PIECE].translate(LETTERS)
                cut, end = part.rfind(b" "), end + PIECE
            if end < len(text):
                part = part[: cut + 1]
        at += len(part)
        if found := part.split():
            yield found


def cells_of(keys: list[bytes], cells: int = CELLS, rows: int = ROWS) -> np.ndarray:
    """Cells (rows, keys) of a sketch that the keys are in."""
    marks = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    step = marks >> np.uint64(32)
    return np.stack([((marks + np.uint64(r) * step * np.uint64(0x9E3779B97F4A7C15) + (step >> np.uint64(7)) * np.uint64(r)) % np.uint64(cells)).astype(np.int64) for r in range(rows)])


def key(lang: str, term: bytes) -> bytes:
    return lang.encode() + b" " + term  # no term has a space


def add(sketch: np.ndarray, keys: list[bytes], counts: list[int], most: int) -> None:
    """Add counts to the cells of keys; cells stop at ``most``."""
    for row, at in zip(sketch, cells_of(keys, sketch.shape[1], len(sketch)), strict=True):
        sums = np.bincount(at, counts, sketch.shape[1])
        np.minimum(row + sums, most, out=row, casting="unsafe")


def estimates(sketch: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """The least cell of each key: at least its true count, or ``most``."""
    return np.min([row[at] for row, at in zip(sketch, cells_of(keys, sketch.shape[1], len(sketch)), strict=True)], axis=0)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str, str]]:
    """(text, lang, source) of each row."""
    for batch in batches:
        for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            yield text.as_buffer().to_pybytes() if text.is_valid else b"", lang, source


def document_sketch(rows: DataFrame, least: int, cells: int, sketch_rows: int) -> np.ndarray:
    """The merged sketch; its size is fixed by ``cells`` and ``sketch_rows``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n = np.zeros((sketch_rows, cells), np.int64), defaultdict(Counter), 0
        for text, lang, _ in groups_of(batches):
            seen: set[bytes] = set()
            for terms in pieces(text):
                seen.update(terms)
            before = len(held[lang])
            held[lang].update(seen)
            n += len(held[lang]) - before
            if n > HELD:
                _flush(sketch, held, least)
                n = 0
        _flush(sketch, held, least)
        flat = sketch.astype(np.uint8 if least < 256 else np.int64).reshape(BLOCKS, -1)
        used = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([flat[b].tobytes() for b in used], pa.binary())], names=["block", "part"])

    def merged(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = None, 0
        for batch in groups:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(part.as_buffer(), np.uint8 if least < 256 else np.int64).astype(np.int64)
                total, block = values if total is None else np.minimum(total + values, least), at
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.uint8 if least < 256 else np.int64).tobytes()])], names=["block", "part"])

    parts = rows.mapInArrow(partial, "block int, part binary").groupBy("block").applyInArrow(merged, "block int, part binary")
    sketch = np.zeros((BLOCKS, sketch_rows * cells // BLOCKS), np.uint8 if least < 256 else np.int64)
    for r in parts.toLocalIterator():  # BLOCKS rows, 2 MiB together
        sketch[r["block"]] = np.frombuffer(r["part"], sketch.dtype)
    return sketch.reshape(sketch_rows, cells)


def _flush(sketch: np.ndarray, held: dict[str, Counter], most: int) -> None:
    for lang, terms in held.items():
        if terms:
            add(sketch, [key(lang, t) for t in terms], list(terms.values()), most)
    held.clear()


COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(df: DataFrame, least: int = LEAST_DOCS, cells: int = CELLS, sketch_rows: int = ROWS, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, source, term, n, lang_n) of the kept terms, and the groups (lang, source) that occur."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    sketch = document_sketch(rows, least, cells, sketch_rows)
    shared = spark.sparkContext.broadcast(sketch)  # 2 MiB at the production values

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, named, n = defaultdict(Counter), defaultdict(Counter), set(), 0
        for body, lang, source in groups_of(batches):
            if (lang, source) not in named:  # it occurs, even without terms; naming it again does no harm
                named = named if len(named) < HELD else set()
                named.add((lang, source))
                yield _rows(lang, source, [b""], [0], [0])
            count, seen = held[lang, source], set()
            before = len(count)
            for terms in pieces(body):
                count.update(terms)
                seen.update(terms)
            docs[lang].update(seen)
            n += len(count) - before + 1
            if n > HELD:
                yield from _survivors(held, docs, shared.value, least)
                n = 0
        yield from _survivors(held, docs, shared.value, least)

    partial = rows.mapInArrow(counted, COUNTS)
    summed = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    of_lang = Window.partitionBy("lang", "term")
    exact = summed.filter("term <> ''").withColumns({"lang_n": F.sum("n").over(of_lang), "_docs": F.sum("docs").over(of_lang)}).filter((F.col("_docs") >= least) & F.col("source").isNotNull())
    return written(exact.select("lang", "source", "term", "n", "lang_n"), "kept"), summed.filter("term = ''").select("lang", "source")


def _rows(lang: str, source: str | None, terms: list[bytes], n: list[int], docs: list[int]) -> pa.RecordBatch:
    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _survivors(held: dict[tuple[str, str], Counter], docs: dict[str, Counter], sketch: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """The counts by source of terms that may be frequent enough, and their documents by language (source null); what was held is let go."""
    may: dict[str, set[bytes]] = {}
    for lang, count in docs.items():
        terms = list(count)
        for at in range(0, len(terms), STEP):
            some = terms[at : at + STEP]
            kept = [some[i] for i in np.flatnonzero(estimates(sketch, [key(lang, t) for t in some]) >= least)]
            may.setdefault(lang, set()).update(kept)
            if kept:
                yield _rows(lang, None, kept, [0] * len(kept), [count[t] for t in kept])
    for (lang, source), count in held.items():
        kept = [t for t in count if t in may[lang]] if may.get(lang) else []
        for at in range(0, len(kept), STEP):
            some = kept[at : at + STEP]
            yield _rows(lang, source, some, [count[t] for t in some], [0] * len(some))
    held.clear()
    docs.clear()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)); the product needs more than 64 bits."""
    product = (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.lit(1).cast("long") + F.call_function("div", product, (total + 2 * kept).cast("decimal(20,0)"))).otherwise(F.lit(0).cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are below 2^31, so all of it fits."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def divergence(df: DataFrame, least: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS, sketch_rows: int = ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): values of each source against each other one, and its most over-used terms."""
    kept, groups = term_counts(df, least, cells, sketch_rows)
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    facts = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    facts = facts.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "v", "lang_total")))
    facts = written(facts.withColumn("p0", share(zero, F.col("total"), F.col("v"))), "groups")  # a row a source
    known = kept.join(facts.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"])
    known = written(known.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))), "shares")
    return _terms(known, top).unionByName(_pairs(known, facts))


def _terms(known: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = known.withColumn("q", q).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # each task first keeps its own first few
    ranked = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(known: DataFrame, facts: DataFrame) -> DataFrame:
    a = facts.select("lang", F.col("source").alias("a"), "v", F.col("terms").alias("a_terms"), F.col("p0").alias("a_p0"))
    b = facts.select("lang", F.col("source").alias("b"), F.col("terms").alias("b_terms"), F.col("p0").alias("b_p0"))
    pairs = a.join(b, "lang").filter("a < b")  # the result itself has a row for each
    # terms that both have: what they add to the sums over each alone
    x = known.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("x"), F.col("p0").alias("x0"))
    y = known.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("y"), F.col("p0").alias("y0"))
    both = x.join(y, ["lang", "term"]).filter("a < b")
    change = gap(F.col("x"), F.col("y")) - gap(F.col("x"), F.col("y0")) - gap(F.col("x0"), F.col("y"))
    both = both.groupBy("lang", "a", "b").agg(F.sum(change).alias("change"), F.count("*").alias("shared"))
    # terms of one source against the other's share of a term it lacks, by how often each share occurs
    sizes = known.groupBy("lang", "source", "p").count()
    lacking = facts.select("lang", F.col("source").alias("other"), F.col("p0").alias("q"))
    alone = sizes.join(lacking, "lang").filter("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("count") * gap(F.col("p"), F.col("q"))).alias("value"))
    one = alone.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.col("value").alias("a_alone"))
    two = alone.select("lang", F.col("source").alias("b"), F.col("other").alias("a"), F.col("value").alias("b_alone"))
    keys, zero = ["lang", "a", "b"], F.lit(0).cast("long")
    joined = pairs.join(both, keys, "left").join(one, keys, "left").join(two, keys, "left").fillna(0, ["change", "shared", "a_alone", "b_alone"])
    neither = F.col("v") - F.col("a_terms") - F.col("b_terms") + F.col("shared")
    value = F.col("a_alone") + F.col("b_alone") + F.col("change") + neither * gap(F.col("a_p0"), F.col("b_p0"))
    valued = joined.select(*keys, F.when(F.col("v") > 0, value).otherwise(zero).alias("value"))
    each = valued.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return each.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))

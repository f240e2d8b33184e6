"""Source divergence, sharding and hard negatives against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import divergence as V
from textloom.llm import hard_negatives as N
from textloom.llm import slots as S
from textloom.llm.shared import new_path

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in mine for t in set(terms))
        kept = {t for t, n in seen.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if t in kept)
        v, total = len(kept), sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(sum(f(p(count[s], t), p(count[o], t)) for t in kept), o) for o in count if o != s]
            term = [(f(p(count[s], t), p(total, t)), t) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


def test_divergence(spark):
    rng = random.Random(5)
    words = ["Straße", "ZEIT", "zeit", "don't", "a1b", "naïve", "日本", *("w" + chr(97 + i) for i in range(26))]
    rows = []
    for i in range(400):
        source = rng.choice(["s1", "s2", "s2", "s2", "ß", None, "s 3"])
        lang = rng.choice(["en", "en", "de", None, "e n"])
        rows.append((None if i % 9 == 0 else i, None if i % 31 == 0 else " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40))) + " once" * (i < 9) + f" {'x' * (i % 50)}", lang, source))
    rows += [(1, "", "xx", "only"), (2, "few words here", "yy", "a"), (3, None, "yy", "b"), (4, "1 2 3", "en", "wordless"), (5, None, None, None)] + [rows[7]] * 30
    df = spark.createDataFrame([(*r, 3, "own") for r in rows], "doc_id long, text string, lang string, source string, n long, term string").repartition(3)
    want = plain_divergence([r[1:] for r in rows])
    assert {tuple(r) for r in V.divergence(df).collect()} == want
    # a sketch so small that nearly every cell is full changes nothing
    assert {tuple(r) for r in V.divergence(df, cells=64, sketch_rows=2).collect()} == want
    assert V.divergence(df.filter("false")).collect() == []


def test_no_language_keeps_a_term(spark):
    got = V.divergence(spark.createDataFrame([(1, "a b", "en", "x"), (2, "a", "en", "y"), (3, "", "de", "z")], "doc_id long, text string, lang string, source string")).collect()
    assert {tuple(r) for r in got} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(V, "PIECE", 7)
    for text in ("one two, three", "averyverylongterm", "ab averyverylongterm cd", "", "  ", "a" * 7 + " b", "äöüäöüäöü ß ab1cd"):
        assert [t.decode() for some in V.pieces(text.encode()) for t in some] == TERM.findall(text)


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9)), max_size=200), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_sketch_never_underestimates(counts, least):
    true, parts = Counter(), []
    for chunk in (counts[::2], counts[1::2]):
        sketch = np.zeros((2, 64), np.int64)
        held = Counter()
        for k, n in chunk:
            held[k] += n
            true[k] += n
        if held:
            V.add(sketch, [str(k).encode() for k in held], list(held.values()), least)
        parts.append(sketch)
    merged = np.minimum(sum(parts), least)
    if true:
        found = V.estimates(merged, [str(k).encode() for k in true])
        assert all(e >= min(n, least) for e, n in zip(found, true.values(), strict=True))


SHARD_ROWS = "doc_id long, text string, shard string, home int"


def shard_rows(n, rng):
    return [(i, "é" * rng.randint(0, 60) + "x" * int(rng.paretovariate(1.1))) for i in range(n)]


def check_shards(out, rows, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want and {r.law for r in out} <= {"bytes"}
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        assert r.grown_shard is None
    assert all(0 <= k < shards for k in by)
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards_hold_near_equal_bytes(spark):
    rows = shard_rows(3000, random.Random(2)) + [(None, None), (None, ""), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], SHARD_ROWS).repartition(5)
    out = S.sharded(df, shards=7).collect()
    load = check_shards(out, rows, 7)
    assert max(load.values()) - min(load.values()) <= max(64, 2 * min(r["size"] for r in out))
    again = S.sharded(df.repartition(2), shards=7).collect()
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in out if r.doc_id != 7} == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in again if r.doc_id != 7}
    assert S.sharded(df.filter("false")).collect() == []


def test_one_record_in_a_third_of_the_rows_is_split(spark):
    rng = random.Random(3)
    rows = shard_rows(2000, rng) + [(5, "the same record")] * 1000 + [(None, None)] * 500 + [(6, "y" * 100_000)]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], SHARD_ROWS).repartition(4)
    out = S.sharded(df, shards=10).collect()
    load = check_shards(out, rows, 10)
    rest = sorted(load.values())
    assert len({r.shard for r in out if r.doc_id == 5}) > 5
    total = sum(load.values()) - rest[-1]
    assert max(rest[:-1]) - min(rest) <= 0.05 * total / 9 or max(rest) - min(rest) <= 0.05 * sum(rest) / 10


def test_maps_have_versions_and_move_little(spark):
    rng = random.Random(4)
    weight = {(k, 0): int(rng.paretovariate(1.3) * 100) for k in range(2000)}
    first = S.even_map(sorted(weight), 40)
    second = S.rebalanced(first, weight, 40)
    load = Counter()
    for slot, k in second.items():
        load[k] += weight[slot]
    share = sum(weight.values()) / 40
    assert max(load.values()) <= max(share + max(1, 0.01 * share), max(weight.values())) and set(second) == set(first)
    third = S.grown(second, weight, 40)
    moved = [s for s in third if third[s] != second[s]]
    assert moved and {third[s] for s in moved} == {40}
    new = sum(weight[s] for s in moved)
    assert 0.9 * (share - max(weight.values()) / 39) * 40 / 41 <= new <= sum(weight.values()) / 41
    assert S.rebalanced(second, weight, 40) == second
    path = new_path(spark, "map")
    for version, m in enumerate((first, second, third)):
        S.save_map(spark, path, version, m)
    assert [S.load_map(spark, path, v) for v in range(3)] == [first, second, third]


def test_shards_are_written(spark):
    rows = shard_rows(300, random.Random(6))
    df = spark.createDataFrame([(*r, "own", i) for i, r in enumerate(rows)], SHARD_ROWS)
    path = new_path(spark, "shards")
    S.write_shards(df, path, 5)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text, r.shard, r.home) for r in back.collect()) == sorted((*r, "own", i) for i, r in enumerate(rows))
    sizes = [r.n for r in back.groupBy("_shard").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 0.2 * sum(sizes) / 5 or max(sizes) > sum(sizes) / 3


def plain_negatives(rows, every=100):
    own = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, la, va in {(i, lab, tuple(v)) for i, lab, v in own if i % every == 0}:
        score = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in own if i != a))
        for p, pid in {(-s, i) for s, i, _ in [x for x in score if x[2] == la][:5]}:
            fit = [(i, -s) for s, i, lab in score if lab != la and 80 * p <= -100 * s <= 100 * p][:5]
            out.update((a, pid, r + 1, i, p, s) for r, (i, s) in enumerate(fit))
    return out


@pytest.mark.parametrize("dim", [3, 70])
def test_hard_negatives(spark, dim, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 64)
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(700, dim)).round(1) + 0.4
    label = rng.choice(10, size=700, p=[0.4, *[0.6 / 9] * 9])
    rows = [(i, int(lab), x.tolist()) for i, (lab, x) in enumerate(zip(label, v, strict=True))]
    rows += [(1000, None, v[0].tolist()), (1100, 3, None), (1200, 3, [None] * dim), (1300, 3, [float("inf")] * dim), (1400, 3, [float("nan")] + [1.0] * (dim - 1)), (1500, 3, [0.0] * dim), (None, 3, v[1].tolist())]
    rows += [(200, rows[200][1], rows[200][2]), (300, 5, v[9].tolist()), (7, 1, v[8].tolist()), (1601, 4, [9000.0] * dim)]
    rows += [(5000 + i, 2, v[3].tolist()) for i in range(40) if (5000 + i) % 100]  # one vector very often
    df = spark.createDataFrame([(*r, "own", 4) for r in rows], "vec_id long, label int, embedding array<double>, mark string, block int").repartition(3)
    got = Counter(tuple(r) for r in N.hard_negatives(df).collect())
    assert got == plain_negatives(rows) and len(got) > 30
    assert N.hard_negatives(df.filter("false")).collect() == [] and N.hard_negatives(df.filter("vec_id = 100")).collect() == []
    odd = df.unionByName(spark.createDataFrame([(9000, 1, [1.0] * (dim + 1), "x", 1), (9100, 1, [1e9] * dim, "x", 1)], df.schema))
    assert Counter(tuple(r) for r in N.hard_negatives(odd).collect()) == got


def test_products_beyond_floats_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 24), 1 << 24, (5, 600)), rng.integers(-(1 << 24), 1 << 24, (7, 600))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    assert N.product(a, b).tolist() == want

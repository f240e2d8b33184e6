"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import wordbatch as W
from textloom.llm.components import components
from textloom.llm.jaccard_join import apart, jaccard_components, join_keys, shingle_sets, sketch
from textloom.llm.substring_dedup import substring_dedup

from .conftest import prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@given(st.lists(st.one_of(st.none(), st.text("ab \t\n\x0b\x1c\u00a0é😀A", max_size=30)), max_size=8), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_words_and_windows(texts, k):
    batch = pa.array(texts, pa.string())
    found = W.split_words(batch, lower=True)
    raw = found.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(found.start[x:y], found.end[x:y], strict=True)] for x, y in zip(found.first[:-1], found.first[1:], strict=True)]
    assert got == [words(t, True) for t in texts]
    hashes, at = W.windows(found, found.hashes(), k)
    flat = [w for g in got for w in g]
    by_text = {}
    for h, a in zip(hashes.tolist(), at.tolist(), strict=True):
        assert by_text.setdefault(h, flat[a : a + k]) == flat[a : a + k]
    assert len(at) == sum(max(0, len(g) - k + 1) for g in got)
    assert len(by_text) == len({tuple(flat[a : a + k]) for a in at.tolist()})


def brute_dedup(rows, k):
    first = {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [5, 13])
def test_substring_dedup(documents, corpus, k):
    got = substring_dedup(documents, k=k).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str)
    assert have == brute_dedup(corpus, k)
    texts = {i: words(t) for i, t in corpus}
    for r in got:
        for s in r.spans:
            assert s.source < r.doc_id and s.words >= k
            assert texts[s.source][s.source_start : s.source_start + s.words] == texts[r.doc_id][s.start : s.start + s.words]


def brute_components(rows):
    sets = []
    for i, text in rows:
        w = words(text, True)
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in itertools.combinations(range(len(sets)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            label[find(y)] = find(x)
    names = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            names[find(x)] = min(names.get(find(x), i), i)
    return sorted(((i, len(s), names.get(find(x), i) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def test_jaccard_components(documents, corpus):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(documents).collect()), key=str)
    assert got == brute_components(corpus)


@given(st.integers(1, 400), st.integers(0, 2**31), st.floats(0, 0.25))
@settings(max_examples=150, deadline=None)
def test_similar_sets_share_a_key(n, seed, change):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    b = np.unique(np.concatenate((a[rng.random(len(a)) >= change / 2], rng.integers(0, 1 << 64, int(n * change / 2), dtype=np.uint64))))
    shared, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    assert apart(sketch(a), sketch(b)) <= union - shared if len(b) else True
    if len(b) and 100 * shared >= 80 * union:
        met = set()
        every = [[(e, set(keys.tolist()), need) for e, keys, need in join_keys(s)] for s in (a, b)]
        for one, two in (every, every[::-1]):
            other = set().union(*(keys for _, keys, _ in two))
            met.add(any(len(keys & other) >= need for _, keys, need in one))
        assert met == {True}


def test_short_and_empty_sets():
    sets = shingle_sets(pa.array(["a b", "A  b", "a b c d e", "", None]))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0] and sets[0][0] == sets[1][0] != sets[2][0]


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (7, 7), (None, 3)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**dict.fromkeys(range(51), 0), 99: 99, 100: 99}


def test_empty_tables(spark, documents):
    none = documents.filter("false")
    assert substring_dedup(none).collect() == [] and jaccard_components(none).collect() == []


def thue_morse(a, b, turns):
    for _ in range(turns):
        a, b = a + b, b + a
    return a, b


def test_words_and_runs_that_differ_in_a_regular_way():
    """Polynomials modulo a power of two cannot tell these apart."""
    a, b = thue_morse("a", "b", 11)
    one, two = W.split_words(pa.array([f"{a} {b}"])).hashes().tolist()
    assert one != two
    x, y = thue_morse(["x"], ["y"], 11)
    found = W.split_words(pa.array([" ".join(x), " ".join(y)]))
    one, two = W.Ranges(found.hashes(), 12345).of(found.first[:-1], found.first[1:]).tolist()
    assert one != two


def test_regular_words_in_the_operators(spark):
    a, b = thue_morse("a", "b", 11)
    rng = random.Random(1)
    rows = [(1, " ".join([*(prose(rng, 6).split()), a, *(prose(rng, 6).split())])), (2, " ".join([*(prose(random.Random(1), 6).split()), b, *(prose(rng, 6).split())]))]
    rows += [(3, " ".join(thue_morse(["x"], ["y"], 9)[0])), (4, " ".join(thue_morse(["x"], ["y"], 9)[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=str) == brute_dedup(rows, 13)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str) == brute_components(rows)


def test_a_row_without_id_links_others(spark):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    far = list(base)
    middle = list(base)
    for i in (20, 60, 100, 140):
        middle[i] = far[i] = "changed"
    for i in (30, 80, 120, 170):
        far[i] = "other"
    rows = [(3, " ".join(far)), (None, " ".join(middle)), (1, " ".join(base)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows) and dict((d, c) for d, _, c in got if d) == {1: 1, 3: 1}


def test_many_sets_in_one_block_stay_in_proportion(spark):
    """Texts with one passage in common and nothing else share sketch blocks, but no partner is looked for."""
    rng = random.Random(3)
    passage = prose(rng, 40)
    vary = [f"{passage} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(600)]
    near = []
    for i in range(60):  # copies of one text that are near each other to all degrees
        w = [f"n{j}" for j in range(150)]
        for j in range(i % 12):
            w[(j * 12 + i) % 150] = f"c{i}x{j}"
        near.append(" ".join(w))
    rows = list(enumerate(vary + near))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows)

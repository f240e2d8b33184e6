"""The latent space of decontamination: of the corpus, smaller than it, and what is found through it."""

import random
import tracemalloc

import numpy as np

import corpus_pipeline as P
from textloom.llm import decontaminate as D
from textloom.llm.wordbatch import split_words


def some_words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(n)]


def test_latent_directions_are_of_the_corpus_and_fewer(spark):
    rng = random.Random(21)
    topics = [some_words(rng, 150) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(topics[i % 12], k=240))) for i in range(150)] + [(900, None), (901, " ")], "doc_id long, text string")
    counts = D.counted(docs)
    rows = sorted(map(tuple, counts.collect()))
    assert rows == sorted(map(tuple, D.counted(docs.unionByName(docs.filter("doc_id < 3")).repartition(7).dropDuplicates()).collect()))
    idf = D.weights(counts)
    sample = {h: words for f, _, h, words in rows if f >= 0}
    assert all(f in words for f, _, _, words in rows if f >= 0)
    a = np.zeros((len(sample), D.FEATURES))
    for i, words in enumerate(sample.values()):
        np.add.at(a[i], words, idf[words])
    a /= np.linalg.norm(a, axis=1)[:, None]
    basis, values = D.latent_basis(counts, idf)
    exact = np.linalg.svd(a, compute_uv=False)
    assert basis.shape == (D.FEATURES, D.RANK) and D.RANK < np.linalg.matrix_rank(a)
    assert np.allclose(basis.T @ basis, np.eye(D.RANK), atol=1e-4) and np.allclose(np.linalg.norm(a @ basis, axis=0), values, rtol=1e-3)
    held = (values**2).sum()
    assert 0.9 * (exact[: D.RANK] ** 2).sum() < held <= (exact[: D.RANK] ** 2).sum() * 1.0001 < (exact**2).sum()


def edited_copies(rng, n):
    """``n`` texts with an item in each, a tenth to two fifths of its words replaced, left out or put in."""
    items, texts = [some_words(rng, rng.randint(12, 60)) for _ in range(6)], []
    for i in range(n):
        share, words = rng.uniform(0.1, 0.4), some_words(rng, rng.randint(20, 200))
        copy = [x for w in items[i % 6] for x in ([w], some_words(rng, 1), [w, *some_words(rng, 1)], [])[rng.choices(range(4), (1 - share, share / 2, share / 4, share / 4))[0]]]
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + copy + words[at:]))
    return texts, [" ".join(x) for x in items]


def all_pairs(texts, items, idf):
    """What the check of every passage with every item finds."""
    hashes = lambda text: split_words(D.pa.array([text]), lower=True).hashes()
    found = set()
    for k, item in enumerate(map(hashes, items)):
        best = sorted(np.argsort(-idf[D.features(item)], kind="stable")[: max(1, len(item) // 3)])
        for i, h in enumerate(map(hashes, texts)):
            near = [h[max(0, s - len(item)) : s + 2 * D.STEP + len(item)].tolist() for s in range(0, len(h), D.STEP)]
            if any(D._checked(item.tolist(), item[best].tolist(), x)[0] for x in near):
                found.add((i, k))
    return found


def test_recall_of_edited_copies_in_tables_of_any_size(spark):
    for n in (4, 8, 20, 90):
        texts, items = edited_copies(random.Random(n), n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = all_pairs(texts, items, D.weights(D.counted(docs)))
        got = {(r.doc_id, r.item_id) for r in D.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
        assert got <= want and len(got) >= 0.95 * len(want) and want


def test_pipeline_drops_edited_copies_through_the_latent_space(spark, tmp_path, monkeypatch):
    texts, items = edited_copies(random.Random(31), 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i for i, _ in all_pairs(texts, items, D.weights(D.counted(docs)))}
    shapes, block = [], D.latent_block
    monkeypatch.setattr(D, "latent_block", lambda pieces, table: shapes.append((len(pieces), table.shape)) or block(pieces, table))
    kept = {r.doc_id for r in P.drop_leaks(spark, docs, str(tmp_path)).collect()}
    dropped = set(range(40)) - kept
    assert dropped <= want and len(dropped) >= 0.95 * len(want) and want
    assert shapes == [(6, (D.FEATURES, D.RANK))]  # the corpus's directions, whatever the number of items


def test_passages_are_folded_in_by_the_singular_vectors(spark):
    rng = random.Random(6)
    topics = [some_words(rng, 150) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(topics[i % 12], k=240))) for i in range(60)], "doc_id long, text string")
    counts = D.counted(docs)
    idf = D.weights(counts)
    basis, values = D.latent_basis(counts, idf)
    table = D.latent_words(counts, idf)
    assert values[0] > D.FLOOR > values[-1]
    for _, _, _, words in counts.filter("feature >= 0").limit(20).collect():
        row = np.bincount(words, minlength=D.FEATURES) * idf
        exact = row @ basis / np.maximum(values, D.FLOOR)
        assert np.allclose(table[words].sum(axis=0), exact, atol=1e-4 * np.linalg.norm(exact))


def test_the_driver_holds_one_matrix_of_words_and_directions(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(some_words(rng, 200))) for i in range(200)], "doc_id long, text string")
    counts = D.counted(docs)
    idf = D.weights(counts)
    tracemalloc.start()
    try:
        D.latent_words(counts, idf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * D.FEATURES * (D.RANK + D.SPARE) * 4


def test_the_stage_of_the_pipeline_keeps_the_driver_small(spark, tmp_path):
    texts, items = edited_copies(random.Random(9), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tracemalloc.start()
    try:
        kept = P.drop_leaks(spark, docs, str(tmp_path))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * D.FEATURES * (D.RANK + D.SPARE) * 4 and 0 < kept.count() < 60

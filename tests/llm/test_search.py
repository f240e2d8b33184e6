"""URL rules, WARC archives, neighbours, decontamination and the pipeline."""

import glob
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as P
from textloom.llm import decontaminate as D
from textloom.llm import hilbert as H
from textloom.llm.shared import new_path, sweep
from textloom.llm import url_rules as U
from textloom.llm.url_rules import url_verdicts
from textloom.llm.warc import captures, page_captures, read_warc, write_warc


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://x.Example.NET/en/1", "http://example.com/de/1?q", "https://a.org/fr/#x", "http://evil-example.com/de/1", "http://net", None, "no host", "http://[::1]/en/", "ftp://a://net/", "http://b.test/a?net/"]
    pages = spark.createDataFrame([(i, u, "tokens") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, labels).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/1", "example.com/de/", "block") and got[3] == ("a.org", "/fr/", "org/fr/", "allow")
    assert got[4] == ("evil-example.com", "/de/1", None, "allow") and got[5] == ("net", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][0] == "[::1]" and got[9] == ("a:", "//net/", None, "allow") and got[10][1] == "/a"


def test_url_rules_odd_tables(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(none, labels).collect() == []
    long = "https://a.test/" + "x/" * 50_000 + "?q=" + "1" * 100_000
    rows = [(1, long), (1, long), (2, "http://b.net/p"), (2, "http://b.net/p"), (None, None)]
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()]
    assert sorted(got, key=str) == sorted([(1, "a.test", 100_001, None, "allow")] * 2 + [(2, "b.net", 2, "net/", "block")] * 2 + [(None, "", 0, None, "allow")], key=str)


def test_mined_rules_block(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'spam-farm' if bad else rng.choice('abc') + 'site'}.test/p/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, "https://spam-farm.other/x"), (901, "https://asite.other/x")]
    got = {r.page_id: r.verdict for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[900] == "block" and got[901] == "allow" and got[0] == "block" and got[1] == "allow"


def plain_rules(baskets, support, confidence, longest):
    """Minimal rules by trying all sets, tokens by name."""
    n, share = len(baskets), sum(bad for _, bad in baskets) / len(baskets)
    found = []
    for size in range(1, longest + 1):
        for some in itertools.combinations(sorted({t for b, _ in baskets for t in b}), size):
            held = [bad for b, bad in baskets if set(some) <= set(b)]
            if sum(held) < max(1.0, support * n) or any(set(r) <= set(some) for r in found):
                continue
            p, k, z = sum(held) / len(held), len(held), U.SURE
            low = (p + z * z / (2 * k) - z * math.sqrt(p * (1 - p) / k + z * z / (4 * k * k))) / (1 + z * z / k)
            if p >= confidence and low > share:
                found.append(some)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_and_verdicts(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.3
        words = [w for w in ("aa", "bb", "cc", "dd", "ee") if rng.random() < (0.6 if bad and w < "cc" or not bad and w > "bb" else 0.3)]
        rows.append((i, f"http://{rng.choice('xyz')}.test/" + "/".join(words) + ("/twin/other" if bad and i % 2 else "")))
        labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", U.host_of(F.col("url")))
    baskets = [(r.tokens, r.page_id) for r in df.select("page_id", U.tokens_of(F.col("url"), F.col("host"), U.path_of(F.col("url"))).alias("tokens")).collect()]
    bad = {i for i, q, _ in labels if q == 0}
    rules = plain_rules([(t, i in bad) for t, i in baskets], 0.02, 0.6, 3)
    got = {r.page_id: r.verdict for r in url_verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=(), support=0.02).collect()}
    assert got == {i: "block" if any(set(r) <= set(t) for r in rules) else "allow" for t, i in baskets}
    assert any(len(r) > 1 for r in rules) and len(set(got.values())) == 2


@pytest.mark.parametrize("bad", [0.2, 0.9])
def test_long_paths_that_repeat(spark, bad):
    path = "/".join("abcdefghijklmnopqrstuvwxyzäöüß")
    rows = [(i, f"http://h.test/{path}" if i % 20 == 0 else f"http://h{i % 7}.test/p{i % 11}") for i in range(2000)]
    rows += [(3000 + i, f"http://h.test/{path}/{'/'.join(f's{k}' for k in range(30) if (k + i) % 9)}") for i in range(60)]
    rng = random.Random(3)
    labels = [(i, int(rng.random() > (bad if "h.test" in u else 0.05)), 0) for i, u in rows]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=()).collect()
    assert {r.verdict for r in got if r.page_id < 3000 and r.page_id % 20 == 0} == {"block" if bad > 0.6 else "allow"}


def test_warc_round_trip(spark):
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 100, "z" * 1000
    rows = [(1, "http://a.test/1", big), (9, "http://a.test/9", "y" * 300_000), (10, "u", "y" * 300_000), (2, "http://a.test/2\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "http://a.test/?q", other), (8, "http://a.test/?q", other), (None, "u", big)]
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame([(*r, "own", 5) for r in rows], "page_id long, url string, html string, digest string, bytes int"), path)
    found = captures(read_warc(spark, path)).cache()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in page_captures(found).collect()), key=str)
    n = len(big.encode())
    want = [(9, 300_000, "revisit", 10), (10, 300_000, "response", None), (1, n, "revisit", 3), (2, n, "revisit", 3), (3, n, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 1000, "response", None), (8, 1000, "response", None), (None, n, "revisit", 3)]
    assert got == sorted(want, key=str)
    assert found.filter("metadata.page_id = 3").first().response.payload == big
    assert found.filter("request is null or metadata is null").count() == 0
    sweep(spark)
    assert not glob.glob(path.removeprefix("file://"))
    empty = new_path(spark, "warc")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert captures(read_warc(spark, empty)).count() == 0


@given(st.integers(1, 4), st.integers(1, 5))
@settings(max_examples=20, deadline=None)
def test_hilbert_curve_is_a_path(n, bits):
    side = 1 << bits
    if side**n > 5000:
        return
    points = np.stack(np.meshgrid(*[np.arange(side)] * n), -1).reshape(-1, n)
    order = H.hilbert_index(points, bits)
    assert sorted(order.tolist()) == list(range(side**n))
    steps = np.abs(np.diff(points[np.argsort(order)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 16))
    v[50:80] = v[0]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double")
    got = H.neighbours(df).collect()
    assert {r.query_id for r in got} == set(range(0, 900, 100)) and len(got) == 90
    hits = 0
    for q in range(0, 900, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 and r.vec_id != q for r in mine)
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(900), d))[:10].tolist()) & {r.vec_id for r in mine})
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == list(range(50, 60))
    assert hits >= 0.9 * 90
    assert len(H.neighbours(df.filter("vec_id < 3")).collect()) == 2 and H.neighbours(df.filter("false")).collect() == []


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.common_subsequence(a, b) == table[-1][-1]


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    items = [[word() for _ in range(n)] for n in (12, 30, 45, 58, 3)]
    docs, want = [], set()
    for i in range(80):
        w = [word() for _ in range(rng.randint(30, 300))]
        if i % 4 == 0:
            k = i // 4 % 4
            copy = [x if rng.random() > 0.12 else word() for x in items[k]] if i % 8 else list(items[k])
            at = rng.randint(0, len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(w).title() if i % 3 == 0 else " ".join(w), "en", "s", 1))
    docs += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "x " + " ".join(items[4]) + " y", "en", "s", 0), (503, " ".join(items[4][:2]), "en", "s", 0)]
    want.add((502, 4))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, " ")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(bench, "item_id long, text string"), want


def test_leaks_are_found_and_no_others(leaky):
    docs, bench, want = leaky
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == want
    assert D.leaks(docs.filter("false"), bench).collect() == [] and D.leaks(docs, bench.filter("false")).collect() == []


def test_leaks_of_odd_rows(spark, leaky):
    docs, bench, want = leaky
    text = {r.doc_id: r.text for r in docs.collect()}
    (one, item), *_ = sorted(want)
    filler = "plain words without any item " * 40_000
    rows = [(None, text[one]), (one, text[one]), (one, text[one]), (7000, filler + text[one]), (7001, filler)]
    df = spark.createDataFrame([(*r, 1.5, "own") for r in rows], "doc_id long, text string, cosine double, start string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(df, bench.withColumn("doc_id", F.lit("x"))).collect()), key=str)
    assert got == sorted([(None, item), (one, item), (one, item), (7000, item)], key=str)
    kept = D.without_leaks(df, bench)
    assert kept.columns == df.columns and [(r.doc_id, r.cosine, r.start) for r in kept.collect()] == [(7001, 1.5, "own")]


def test_items_go_in_blocks(leaky, monkeypatch):
    docs, bench, want = leaky
    monkeypatch.setattr(D, "ITEMS_A_PASS", 2)
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == want


def test_pipeline_stages(spark, leaky, tmp_path):
    docs, bench, want = leaky
    rows = docs.unionByName(docs.filter("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 700)).unionByName(spark.createDataFrame([(900, "password=hunter22 and some words that are fine here", "en", "s", 51)], docs.schema))
    rows = rows.withColumns({c: F.lit("own") for c in ("score", "size", "spans", "_nth", "a.b")})  # names that the stages use themselves
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    none = rows.filter("false")
    assert all(stage(spark, none, str(tmp_path)).collect() == [] for _, stage in P.STAGES)
    kept = P.keep_good(spark, rows, str(tmp_path))
    assert {r.score for r in kept.collect()} == {"own"}
    assert kept.count() == rows.count() and kept.columns == rows.columns
    kept = P.keep_one_of_each(spark, rows, str(tmp_path))
    assert {r.doc_id for r in rows.collect()} - {r.doc_id for r in kept.collect()} == {701, 702} and kept.columns == rows.columns
    kept = P.drop_leaks(spark, rows, str(tmp_path))
    assert {r.doc_id for r in rows.collect()} - {r.doc_id for r in kept.collect()} == {i for i, _ in want} and kept.columns == rows.columns
    kept = P.hide_secrets(spark, rows, str(tmp_path))
    hidden = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert len(hidden) == rows.count() and hidden[900] == ("[secret] and some words that are fine here", 42) and kept.columns == rows.columns
    out = P.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and not set(ids) & {i for i, _ in want} and not set(ids) & {701, 702}
    assert abs(sum(r.taken for r in out) - out[0].target) < 0.05 * out[0].target


def test_pipeline_takes_rows_without_id_and_any_column(spark, leaky, tmp_path):
    docs, bench, want = leaky
    text = {r.doc_id: r.text for r in docs.collect()}
    leak = min(want)[0]
    good = [i for i in text if i < 80 and i not in {d for d, _ in want}]
    rows = [(i, text[i]) for i in good]
    rows += [(None, text[leak]), (None, text[good[0]]), (None, "alone " * 3 + text[good[1]][::-1]), (None, "alone " * 3 + text[good[1]][::-1]), (None, None), (None, None), (good[2], text[good[2]]), (good[3], "other words under the same id and a token=abcdefgh1")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), (n, [n])) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, odd struct<`a-b`:int,`c d`:array<int>>")
    df = df.withColumn("pairs", F.create_map(F.lit("k y"), F.lit(1)))
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    def numbers(stage):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        return sorted(r.odd["a-b"] for r in out.collect())

    every = list(range(len(rows)))
    n = len(good)
    assert numbers(P.keep_good) == every and numbers(P.hide_secrets) == every
    assert numbers(P.drop_leaks) == [i for i in every if i != n]
    kept = numbers(P.keep_one_of_each)
    assert n + 1 not in kept and len({n + 2, n + 3} & set(kept)) == 1 and {n + 4, n + 5, n + 7} < set(kept)
    assert len({2, n + 6} & set(kept)) == 1 and len(kept) == len(rows) - 3
    mixed = P.mix_sources(spark, df, str(tmp_path)).collect()
    assert len({r.odd["a-b"] for r in mixed}) == len(mixed) and abs(sum(r.taken for r in mixed) - mixed[0].target) < 0.05 * mixed[0].target
    assert sorted((r.odd["a-b"], r.copies) for r in mixed) == sorted((r.odd["a-b"], r.copies) for r in P.mix_sources(spark, df.repartition(3), str(tmp_path)).collect())
    assert P.run(spark, str(tmp_path)).count() > 0


def test_copies_are_found_among_more_items_than_rank(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    items = [[word() for _ in range(rng.randint(30, 58))] for _ in range(2000)]
    docs, want = [], set()
    for i in range(300):
        w = [word() for _ in range(rng.randint(30, 200))]
        if i % 3:
            k = rng.randrange(2000)
            at = rng.randint(0, len(w))
            w[at:at] = [word() if i % 3 == 2 and n % 9 == 4 else x for n, x in enumerate(items[k])]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


@pytest.mark.parametrize("every", [0, 9])
def test_long_items_are_found(spark, every):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    items = [[word() for _ in range(n)] for n in (81, 500, 800, 1500, 3000)]
    docs = [[word() for _ in range(60)] for _ in range(12)]
    for k, item in enumerate(items):
        docs[k][17 + k : 17 + k] = [word() if every and n % every == 4 else x for n, x in enumerate(item)]
    docs[5][30:30] = items[2][:200]  # a quarter is no copy
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    found = D.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(5)]


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist()), (5, v[5].tolist()), (5, (v[5] + 1).tolist())]
    got = H.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in range(0, 400, 100):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and len({i for _, i, _ in mine}) == 10 and q not in {i for _, i, _ in mine}


def test_neighbours_of_small_tables(spark):
    for n in (5, 8, 11, 12, 15, 30):
        v = np.random.default_rng(n).normal(size=(n, 16))
        found = H.neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=1).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in found} == {i: min(10, n - 1) for i in range(n)}

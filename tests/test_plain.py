"""Operators without SQL against plain Python on small fixtures, through their registered queries."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import web as W
from textloom.functions.stem import stem
from textloom.functions.text import normalized
from textloom.operators import matching as M
from textloom.plans.registry import QUERIES
from textloom.streaming import events as E

LETTERS = "abcdefghijklmnop"


def word(rng):
    return "".join(rng.choices(LETTERS, k=rng.randint(2, 6)))


@pytest.fixture(scope="module")
def bodies():
    """(doc_id, text): random texts, exact and near copies of all degrees, parts, short and empty ones."""
    rng = random.Random(21)
    texts = [[word(rng) for _ in range(rng.randint(1, 90))] for _ in range(25)]
    base = [word(rng) for _ in range(400)]
    for i in range(14):
        w = list(base)
        for j in range(i):
            w[(j * 29 + i * 3) % 400] = word(rng)
        texts.append(w)
    texts += [base, texts[0], texts[1] * 2, base[:200], base[100:380], base + texts[2], [], ["one", "two"], ["one", "two"], texts[3] + ["end"]]
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, bodies, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain")
    spark.createDataFrame([(i, t, len(t)) for i, t in bodies], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def sets_of(bodies):
    out = {}
    for i, t in bodies:
        w = re.findall(r"\w+", t)
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def test_near_and_part_pairs(spark, folder, bodies):
    sets = sets_of(bodies)
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(frozenset(s), i)
    reps = sorted(first.values())
    near, part, holders = set(), set(), {}
    for a, b in itertools.combinations(reps, 2):
        shared, union, small = len(sets[a] & sets[b]), len(sets[a] | sets[b]), min(len(sets[a]), len(sets[b]))
        if 10 * shared >= 8 * union:
            near.add((a, b))
        if 10 * shared >= 9 * small:
            holder, held = (a, b) if len(sets[a]) >= len(sets[b]) else (b, a)
            holders.setdefault(holder, set()).add(held)
            if 10 * shared < 8 * union:
                part.add((a, b, len(sets[a]) <= len(sets[b])))
    assert len(near) > 20 and len(part) >= 3
    assert {tuple(r) for r in QUERIES["N9_copy_pairs"](spark, folder).collect()} == near
    assert {tuple(r) for r in QUERIES["N11_containment"](spark, folder).collect()} == part
    words, two = {i: re.findall(r"\w+", t) for i, t in bodies}, set()
    for holder, held in holders.items():  # passages by their places in the holder, every pair of them tried
        runs = [tuple(words[holder][j : j + 5]) for j in range(len(words[holder]) - 4)]
        places = [(min(at), max(at) + 5) for part in held if (at := [j for j, r in enumerate(runs) if r in sets[part]])]
        if any(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(places, 2)):
            two.add((holder, len(places)))
    assert two and {tuple(r) for r in QUERIES["N21_holders_of_two"](spark, folder).collect()} == two
    label = {i: i for i in sets}
    links = near | {(first[frozenset(s)], i) for i, s in sets.items() if s}
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.cluster for r in QUERIES["N13_components"](spark, folder).collect()} == label
    found = {r.id: r.cluster for r in QUERIES["N9_copy_clusters_minhash"](spark, folder).collect()}
    assert set(found) == set(label) and all(found[i] >= label[i] for i in label)  # links may be missed, none is made up
    assert sum(found[i] == label[i] for i in label) >= 0.9 * len(label)


def test_ordered_clusters_hold_together(spark, folder, bodies):
    sets = sets_of(bodies)
    found = {r.id: r.cluster for r in QUERIES["N10_ordered_clusters"](spark, folder).collect()}
    assert set(found) == set(sets)
    for a, b in itertools.combinations(sets, 2):
        if found[a] == found[b]:
            assert 10 * len(sets[a] & sets[b]) >= 3 * min(len(sets[a]), len(sets[b]))
    assert found[0] == found[26 + 14] == 0 and len(set(found.values())) < len(found)


def plain_one_word(part, whole):
    """Every stretch of the whole, tried with every single change."""
    n = len(part)
    for begin in range(len(whole)):
        for size in (n - 1, n, n + 1):
            stretch = whole[begin : begin + size]
            if len(stretch) != size:
                continue
            if stretch == part and size == n:
                return True
            ahead = next((i for i, (x, y) in enumerate(zip(part, stretch)) if x != y), min(n, size))
            for lost, there in ((1, 1), (1, 2), (2, 1), (0, 1), (1, 0)):
                if size != n - lost + there:
                    continue
                for at in range(5, ahead + 1):
                    tail = part[at + lost :]
                    if len(tail) >= 5 and stretch[at + there :] == tail:
                        return True
    return False


def test_but_for_one_word():
    rng = random.Random(2)
    seen = set()
    for _ in range(400):
        part = rng.choices("abc", k=rng.randint(8, 16))
        whole = list(part)
        at, kind = rng.randrange(len(part)), rng.randrange(6)
        if kind < 3:
            whole[at : at + (kind > 0)] = ["x"] * (1 + (kind == 2))
        elif kind == 3:
            del whole[at]
        elif kind == 4:
            whole[at : at + 2] = ["x"]
        whole = rng.choices("abc", k=rng.randint(0, 4)) + whole + rng.choices("abc", k=rng.randint(0, 4))
        got = M.but_for_one_word(part, whole)
        assert got == plain_one_word(part, whole), (part, whole)
        seen.add(got)
    assert seen == {True, False} and not M.but_for_one_word(["a"] * 4, ["a"] * 4)


def test_leader_clusters(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(i % 5 * 10, i % 5 * 10 + 10)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(10)] = word(rng)
        rows.append((i, " ".join(w)))
    for i in range(60, 90):  # chains: each is like the next, ends are not alike
        rows.append((i, " ".join(f"v{j}" for j in range(i, i + 14))))
    rows += [(90, rows[3][1]), (91, ""), (92, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    leaders = []
    for i, w in sorted(((i, sorted(set(t.split()))) for i, t in rows), key=lambda x: (-len(x[1]), x[1], x[0])):
        name = next((n for n, o in leaders if not o | set(w) or 4 * len(o & set(w)) >= 3 * len(o | set(w))), None)
        if name is None:
            leaders.append((i, set(w)))
        want[i] = i if name is None else name
    assert {r.id: r.leader for r in QUERIES["C12_leader_clusters"](spark, str(tmp_path)).collect()} == want
    assert len(set(want.values())) < len(want)


PAGE = "<html><head><title>A</title></head><body><nav><ul><li>Home</li><li>About us</li></ul></nav><main><article><h1>Head</h1>{}</article></main><footer><p>All rights</p></footer></body></html>"


def test_main_text_and_extraction(spark, tmp_path):
    long = [f"Sentence number {i} of the story that is told here at some length." for i in range(6)]
    pages = [PAGE.format("".join(f"<p>{s}</p>" for s in long)), "<body><header><p>Menu</p></header><div>Only this block</div></body>", "", None, PAGE.format("<p>short</p>").replace("</main>", "</main><p>" + "outside text " * 30 + "</p>")]
    spark.createDataFrame([(i, f"http://a.test/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    main = [W.read_page(p)["main"] for p in pages]
    assert main[0].split("\n") == ["Head", *long] and main[1] == "Only this block" and main[2] == main[3] == "" and "outside text" in main[4] and "Home" not in main[4] and "All rights" not in main[4]
    rows = {r.page_id: (r.main_chars, r.visible_chars) for r in QUERIES["S3_main_text"](spark, str(tmp_path)).collect()}
    assert rows[0][0] == len(main[0]) < rows[0][1] and rows[3] == (0, 0)
    got = QUERIES["A30_extraction_quality"](spark, str(tmp_path)).first()
    read = [W.read_page(p) for p in pages]
    shares = [r["visible_chars"] / len(p) for r, p in zip(read, pages, strict=True) if p]
    assert got.blocks == sum(r["blocks"] for r in read) and got.empty == 2 and abs(got.text_share - sum(shares) / len(shares)) < 1e-6


def test_stems_and_unicode_form(spark, tmp_path):
    rows = [(1, "Running runners ran the running"), (2, "The runner’s CAFÉ — ﬁne “quotes” ＡＢＣ"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.term: (r.tf, r.df) for r in QUERIES["R21_stemmed_postings"](spark, str(tmp_path)).collect()}
    assert found[stem("the")] == (2, 2) and found[stem("runner")] == (2, 2) and all(df > 1 for _, df in found.values())
    assert normalized(rows[1][1]) == "the runner's café - fine \"quotes\" abc" and normalized(None) is None


def test_registrable_domains():
    rules = W.suffix_rules("// a comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\ngithub.io // private\nio\n")
    want = {"www.bbc.co.uk": "bbc.co.uk", "co.uk": None, "a.b.com": "b.com", "y.ck": None, "x.y.ck": "x.y.ck", "a.x.y.ck": "x.y.ck", "www.ck": "www.ck", "alice.github.io": "alice.github.io", "a.alice.github.io": "alice.github.io", "127.0.0.1": None, "a..b": None, "": None, "host.unknown": "host.unknown"}
    assert {h: W.registrable_by_rules(h, rules) for h in want} == want


def test_domains_by_column(spark):
    hosts = ["www.bbc.co.uk", "a.b.example.com", "alice.github.io", "EXAMPLE.org"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(W.registrable_domain(F.col("h"))).collect()]
    assert got == ["bbc.co.uk", "example.com", "alice.github.io", "example.org"]


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


def run_stream(spark, df, tmp_path, build, mode):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    stream = build(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/offsets").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return out


def test_pacer_keeps_its_burst(spark, tmp_path, small_batches):
    rows = [(i, f"2024-01-01 00:0{i // 6}:{i % 6 * 10:02}", 1) for i in range(12)] + [(50, "2024-01-01 03:00:00", 1), (60, "2024-01-01 00:00:00", 2)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.user_id, r.sent, r.event_id) for r in run_stream(spark, df, tmp_path, lambda s: E.paced(s, 3, 60.0), "append"))
    mine = [(t.hour * 3600 + t.minute * 60 + t.second, e) for u, t, e in got if u == 1]
    sent = []
    for at, e in [(i * 10, i) for i in range(12)] + [(10800, 50)]:
        sent.append(max([at, *(s for s in sent[-1:]), *([sent[-3] + 180] if len(sent) >= 3 else [])]))
    assert [t for t, _ in mine] == sent and [e for _, e in mine] == [*range(12), 50] and len(got) == 14


def test_long_chains_settle(spark):
    from textloom.operators.entities import min_label_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "id long")
    assert {r.component for r in min_label_components(nodes, edges).collect()} == {0}


def test_canonical_urls_in_full():
    want = {
        "HTTP://M.Example.co.uk:80/a/../b/./c%7e?utm_source=x&b=2&a=1&fbclid=9#top": "http://example.co.uk/b/c~?a=1&b=2",
        "https://example.org:8443": "https://example.org:8443/", "https://example.org/story/amp/?amp=1": "https://example.org/story", "https://example.org/?amp=watts&outputType=amp": "https://example.org/?amp=watts",
        "https://www.google.com/url?q=https%3A%2F%2Fnews.test%2Fp%3Fid%3D7%26gclid%3D1": "https://news.test/p?id=7",
        "ftp://example.org/": None, "not a url": None, None: None, "http://bad:port/": None,
    }
    got = {u: W.canonical(u) for u in want}
    assert got == want
    assert all(W.canonical(c) == c for c in got.values() if c)

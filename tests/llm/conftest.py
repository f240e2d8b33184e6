"""Small fixtures for the training-data operators."""

import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to") for b in ("dan", "fel", "gir", "hop", "jun", "kat", "lem", "mis", "nor", "pas")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random prose with copies, near copies, shared passages, repeats and odd rows."""
    rng = random.Random(4)
    docs = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 60)
    rows = list(enumerate(docs))
    rows += [(100 + i, docs[i]) for i in range(5)]
    for i in range(12):  # near copies of one text, some near each other only
        w = docs[7 % len(docs)].split() or ["x"]
        for _ in range(i):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{prose(rng, 9)} {passage} {prose(rng, 7)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "one  two"), (405, "echo " * 80), (406, prose(rng, 4000)), (407, "x" * 5000), (408, "ärger über ﬁn\u00a0fin")]
    rows += [(409, "Echo " * 80), (None, docs[1]), (0, docs[0]), (0, docs[0])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with the other columns of documents, and some that clash with names used inside."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "clash", 1.5, [3]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string, size double, spans array<int>").repartition(3)

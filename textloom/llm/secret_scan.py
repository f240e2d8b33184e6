"""Secret scans: fixed patterns, and character Markov models compared by likelihood.

Two first-order Markov models over 70 character classes are trained from
labelled samples: random strings (the values that the fixed patterns find,
with a seeded set of generated keys) and ordinary identifiers and words (all
other runs of identifier characters, with generated identifiers).  Runs that
the models are to judge teach neither.  Transition counts cover every text.
A run of at least 20 identifier characters with a letter and a digit is an
added secret when the mean log-likelihood ratio of its transitions is above a
threshold and it meets no span of the patterns.

Cases: null text is empty; empty text has no spans and hashes the empty
string; texts of any length are scanned whole; repeated rows are scanned each;
an empty table trains on the generated keys alone and gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm.shared import small_batches
from textloom.llm.wordbatch import slices

#: fixed patterns, with the least length of the group that counts
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: mean log2 likelihood ratio a transition above which a run is a secret
THRESHOLD = 0.8
SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.,:"
N = len(SYMBOLS)
CLASS = np.full(256, N - 1, np.int64)
CLASS[list(SYMBOLS)] = np.arange(N)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def taught(text: str) -> tuple[list[str], str]:
    """Values of the fixed patterns (random strings), and the text without them, shorter ones of their kind and runs that the models judge."""
    spans = [m.span() for m in RUN.finditer(text) if _mixed(m[0])]
    values = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            spans.append(m.span())
            if len(m[2]) >= ASSIGN_LEAST:
                values.append(m[2])
    for m in [*(ACCESS.finditer(text) if "AKIA" in text else ()), *HEX.finditer(text)]:
        spans.append(m.span())
        if m.re is HEX or m.end() - m.start() >= ACCESS_LEAST:
            values.append(m[0])
    rest, at = [], 0
    for a, b in sorted(spans):
        rest.append(text[at : max(a, at)])
        at = max(at, b)
    return values, " ".join([*rest, text[at:]])


def generated_keys(n: int = 2000, seed: int = 11) -> list[bytes]:
    """Labelled random strings of the usual alphabets."""
    rng = random.Random(seed)
    alphabets = (SYMBOLS[:62], SYMBOLS[:65], SYMBOLS[26:62], b"0123456789abcdef", SYMBOLS[:26] + SYMBOLS[52:62])
    return [bytes(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))) for i in range(n)]


#: fixed values: parts of ordinary identifiers
PARTS = "get set is has add remove user account name list map index count value item node path file text data type key event handler manager service factory builder config option default parse format write read open close start stop next last first total size length order status error message request response session token test model view page number date time long identifier thing for the to from with by".split()


def generated_identifiers(n: int = 4000, seed: int = 12) -> list[bytes]:
    """Labelled ordinary identifiers: parts in camel, snake or kebab case, some with a number."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = rng.choices(PARTS, k=rng.randint(2, 6))
        if i % 3 == 0:
            parts[rng.randrange(len(parts))] += str(rng.randint(0, 99))
        name = "".join(p.capitalize() for p in parts) if i % 2 else ("_" if i % 4 else "-").join(parts)
        out.append((name[0].lower() + name[1:]).encode())
    return out


def transitions(data: np.ndarray) -> np.ndarray:
    c = CLASS[data]
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of one task: ordinary text and the values of the patterns."""
    ordinary, secret = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
    for batch in slices(batches, "text"):
        both = [taught(text or "") for text in batch.column(0).to_pylist()]
        c = CLASS[np.frombuffer("\n".join(rest for _, rest in both).encode(), np.uint8)]
        inside = c < N - 3
        ordinary += np.bincount((c[:-1] * N + c[1:])[inside[:-1] & inside[1:]], minlength=N * N)
        for value in (v for values, _ in both for v in values):
            secret += transitions(np.frombuffer(value.encode(), np.uint8))
    at = np.flatnonzero(ordinary + secret)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ordinary[at]), pa.array(secret[at])], names=["pair", "ordinary", "secret"])


def ratio_table(ordinary: np.ndarray, secret: np.ndarray) -> np.ndarray:
    """log2 P_random(b|a) / P_ordinary(b|a), smoothed."""
    secret = secret.copy()
    for key in generated_keys():
        secret += transitions(np.frombuffer(key, np.uint8))
    # one sample size for both labels, so that rare classes are not judged by corpus size;
    # ordinary text is half the corpus, half generated identifiers
    named = np.zeros(N * N)
    for name in generated_identifiers():
        named += transitions(np.frombuffer(name, np.uint8))
    half = secret.sum() / 2
    ordinary = ordinary * (half / max(1, ordinary.sum())) + named * (half / named.sum())
    out = []
    for counts in (secret, ordinary):
        table = counts.reshape(N, N) + 0.5
        out.append(np.log2(table / table.sum(1, keepdims=True)))
    return out[0] - out[1]


def _mixed(run: str) -> bool:
    """Whether a run has both a digit and a letter."""
    return any("0" <= x <= "9" for x in run) and any(x.isalpha() for x in run)


def markov_spans(text: str, base: list[tuple[int, int, int]], ratios: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    found = []
    ends = np.maximum.accumulate([b for _, b, _ in base]).tolist() if base else []
    starts = [a for a, _, _ in base]
    for m in RUN.finditer(text):
        run = m[0]
        if not _mixed(run):
            continue
        i = bisect_left(starts, m.end())  # spans that begin before this run ends
        if i and ends[i - 1] > m.start():
            continue
        c = CLASS[np.frombuffer(run.encode(), np.uint8)]
        if ratios[c[:-1], c[1:]].mean() > threshold:
            found.append((m.start(), m.end(), 3))
    return found


SCANNED = "doc_id long, spans array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, n_hex long, base_sha256 string, span_list string, redacted string"


def _scan(table: list, threshold: float, redact: bool):
    ratios = np.array(table)

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                every = sorted(base + markov_spans(text, base, ratios, threshold), key=lambda s: (s[0], s[2]))
                kinds = [k for _, _, k in base]
                hidden = None
                if redact:
                    parts, at = [], 0
                    for a, b, _ in every:
                        if b > at:
                            parts += [text[at:a] if a > at else "", "[secret]"] if a >= at else []
                            at = b
                    hidden = "".join([*parts, text[at:]])
                rows.append(([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every], kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), hidden))
            cols = list(zip(*rows, strict=True))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:4]), *(pa.array(c, pa.string()) for c in cols[4:]), *batch.columns[2:]],
                names=["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "span_list", "redacted", *batch.schema.names[2:]],
            )

    return scan


def secret_scan(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, redact: bool = False, carry: tuple = ()) -> DataFrame:
    """One row per document: its secrets' spans (code points, end exclusive), counts, digests, if asked the redacted text, and the ``carry`` columns."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    ordinary, secret = np.zeros(N * N), np.zeros(N * N)
    counted = docs.select("text").mapInArrow(_counts, "pair long, ordinary long, secret long")
    for pair, a, b in counted.groupBy("pair").agg(F.sum("ordinary"), F.sum("secret")).collect():  # N * N rows at most
        ordinary[pair], secret[pair] = a, b
    schema = StructType([*StructType.fromDDL(SCANNED).fields, *docs.schema.fields[2:]])
    out = docs.mapInArrow(_scan(ratio_table(ordinary, secret).tolist(), threshold, redact), schema)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})

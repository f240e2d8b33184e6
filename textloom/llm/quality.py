"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 48 words.  Every passage is encoded as 18
measures of its characters and words.  Gated attention, softmax of
w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted mean of
their hidden layer is scored by a logistic output.  Labels belong to documents
only, and one junk passage among good ones can still speak.

Training takes a bounded sample of labelled documents (``sample`` documents,
the smallest hashes of doc_id among those of the training folds, half of each
label as far as there are; of each at most ``bag`` passages, evenly spread).
Scoring encodes every passage of every document.

Cases: null or wordless text is a bag with one passage of zeros; texts of any
length are scored whole; a doc_id with several labels counts as their mean,
0.5 and up as good; with only one label, or none, the score is the smoothed
share of good labels (0.5 without labels); repeated rows are scored each; a
null doc_id is not held out and not learned from; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.shared import small_batches
from textloom.llm.wordbatch import slices, split_words

PASSAGE = 48
SAMPLE, BAG = 6000, 48
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
MEASURES = 18
_KIND = np.full(256, 5, np.int64)  # 0 lower, 1 upper, 2 digit, 3 sentence mark, 4 other mark, 5 beyond ASCII
_KIND[:128] = 4
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 0, 1, 2
_KIND[list(b".,;:'\"-?")] = 3


def passages(column: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage, and how many passages each text has (one at least)."""
    words = split_words(column)
    counts = words.counts()
    bags = np.maximum(1, -(-counts // size))
    total = int(bags.sum())
    out = np.zeros((total, MEASURES))
    n = len(words.start)
    if not n:
        return out, bags
    text = words.text_of()
    bag = (np.cumsum(bags) - bags)[text] + (np.arange(n) - words.first[text]) // size
    kinds = np.zeros((len(words.data) + 1, 6), np.int32)
    for k in range(6):
        np.cumsum(_KIND[words.data] == k, out=kinds[1:, k])
    per_word = (kinds[words.end] - kinds[words.start]).astype(float)
    length = (words.end - words.start).astype(float)
    last = _KIND[words.data[words.end - 1]]
    first = _KIND[words.data[words.start]]
    h = words.hashes()
    same = np.zeros(n)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((h, bag))
    fresh = np.ones(n)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (bag[order][1:] != bag[order][:-1])

    def add(values: np.ndarray, at: np.ndarray = bag) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=total)

    num = np.maximum(1, add(np.ones(n)))
    chars = np.maximum(1, add(length))
    for k in range(6):
        out[:, k] = add(per_word[:, k]) / chars
    marks = per_word[:, 3] + per_word[:, 4]
    out[:, 6] = add((per_word[:, 4] >= 2).astype(float)) / num
    out[:, 7] = add((marks == length).astype(float)) / num
    out[:, 8] = add((per_word[:, 1] * 2 > length).astype(float)) / num
    out[:, 9] = add((first == 1).astype(float)) / num
    out[:, 10] = add((last == 3).astype(float)) / num
    out[:, 11] = add((last == 4).astype(float)) / num
    out[:, 12] = add(same) / num
    out[:, 13] = add(fresh, bag[order]) / num
    out[:, 14] = chars / num / 10
    out[:, 15] = np.sqrt(np.maximum(0, add(length**2) / num - (chars / num) ** 2)) / 10
    out[:, 16] = add((length > 24).astype(float)) / num
    out[:, 17] = num / size
    return out, bags


def _bags(column: pa.Array) -> list[np.ndarray]:
    x, bags = passages(column)
    return np.split(x, np.cumsum(bags)[:-1])


class AttentionModel:
    """Gated attention over passages; trained by Adam on document labels."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {
            "H": rng.normal(0, 0.3, (MEASURES, hidden)), "hb": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, attention)),
            "U": rng.normal(0, 0.3, (hidden, attention)), "a": rng.normal(0, 0.3, attention), "o": rng.normal(0, 0.3, hidden), "ob": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Scores of consecutive bags that begin at ``starts``."""
        w, x = self.w, np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["H"] + w["hb"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * alpha[:, None], starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": p, "sizes": sizes}

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        w = self.w
        d = (f["p"] - y) * weight / len(y)
        out = {"o": f["z"].T @ d, "ob": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["o"], f["sizes"], axis=0)
        pull = (f["h"] * dz).sum(1)
        mean = np.repeat(np.add.reduceat(f["alpha"] * pull, np.cumsum(f["sizes"]) - f["sizes"]), f["sizes"])
        de = f["alpha"] * (pull - mean)
        out["a"] = (f["t"] * f["g"]).T @ de
        dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (dz * f["alpha"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        out["H"], out["hb"] = f["x"].T @ dh, dh.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 3) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = np.concatenate([bags[i] for i in pick])
                sizes = np.array([len(bags[i]) for i in pick])
                got = self.gradients(self.forward(x, np.cumsum(sizes) - sizes), y[pick], weight[pick])
                step += 1
                for k, v in got.items():
                    v = v + 1e-5 * self.w[k]
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * v * v
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _fold(doc):
    return F.crc32(doc.cast("string")) % FOLDS


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bag: int = BAG):
    """A model of P(label 1), or a plain number where the labels hold one class only. ``docs``: doc_id, text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).dropna()
    known = known.filter(_fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))
    shares = dict(known.groupBy("label").count().collect())
    if len(shares) < 2:
        return (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    rank = F.xxhash64(F.lit("quality"), "doc_id")
    each = [known.filter(F.col("label") == v).orderBy(rank, "doc_id").limit(sample // 2) for v in (0, 1)]
    chosen = each[0].unionByName(each[1])  # ``sample`` rows at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _bags(batch.column(1))
            found = [b[np.linspace(0, len(b) - 1, min(bag, len(b))).astype(int)] for b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in found], pa.binary())], names=["label", "bag"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(encode, "label int, bag binary").collect()
    bags = [np.frombuffer(r[1]).reshape(-1, MEASURES) for r in sorted(rows)]
    y = np.array([r[0] for r in sorted(rows)], float)
    if len(set(y)) < 2:
        return (shares[1] + 1) / (sum(shares.values()) + 2)
    # each class weighs as its share of all training labels, so that scores are probabilities
    share = shares[1] / (shares[0] + shares[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return AttentionModel().fit(bags, y, weight)


def _apply(model):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if isinstance(model, float):
                p = np.full(batch.num_rows, model)
            else:
                x, bags = passages(batch.column(batch.schema.get_field_index("text")))
                p = model.forward(x, np.cumsum(bags) - bags)["p"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    return apply


def quality_scores(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE, carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and the ``carry`` columns."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    model = fit_quality(docs.select("doc_id", "text").dropna(subset=["doc_id"]), labels, sample)
    kept = docs.columns if carry else ["doc_id", "text"]
    scored = docs.select(*kept).mapInArrow(_apply(model), StructType([*docs.select(*kept).schema.fields, StructField("score", DoubleType())]))
    return scored.select(
        "doc_id", F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        *(["text"] if carry else []), *(F.col(f"carry_{c}").alias(c) for c in carry),
    )

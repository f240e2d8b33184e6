"""A trained text model: (1 + ln tf) * idf, unit length, multinomial logistic regression.

The vocabulary, the inverse document frequencies and the coefficients are
learned by Spark ML from labelled rows; they become a table (term, idf,
coefficients), and every text is scored by a join with it.  The table has at
most ``vocabulary`` rows, so its size is known.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = 8192


@dataclass(frozen=True)
class TextModel:
    """``terms``: term, idf, coefficients (one a class, in the order of ``classes``)."""

    terms: DataFrame
    classes: tuple[str, ...]
    intercepts: tuple[float, ...]


@F.udf(VectorUDT())
def _damped(counts: SparseVector) -> SparseVector:
    """Counts as 1 + ln."""
    return SparseVector(counts.size, counts.indices, [1.0 + math.log(c) for c in counts.values])


def fit(rows: DataFrame, tokens: str, label: str, vocabulary: int = VOCABULARY, least_docs: int = 2, rounds: int = 60, penalty: float = 1e-4) -> TextModel | None:
    """Learn from labelled rows (tokens: array<string>); None without two classes or without a word."""
    spark = rows.sparkSession
    known = rows.filter(F.col(label).isNotNull() & (F.size(tokens) > 0)).select(F.col(tokens).alias("tokens"), F.col(label).cast("string").alias("label"))
    classes = tuple(sorted(r[0] for r in known.select("label").distinct().collect()))  # the classes of a label
    if len(classes) < 2:
        return None
    counter = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocabulary, minDF=least_docs).fit(known)
    if not counter.vocabulary:
        return None
    number = F.create_map(*(x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))))
    counted = counter.transform(known).select(_damped("counts").alias("tf"), F.element_at(number, F.col("label")).alias("y"))
    idf = IDF(inputCol="tf", outputCol="weighed").fit(counted)
    data = Normalizer(inputCol="weighed", outputCol="x", p=2.0).transform(idf.transform(counted)).select("x", "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=rounds, regParam=penalty).fit(data)
    matrix = model.coefficientMatrix.toArray()
    terms = [(t, float(w), [float(v) for v in matrix[:, i]]) for i, (t, w) in enumerate(zip(counter.vocabulary, idf.idf.toArray(), strict=True))]
    return TextModel(spark.createDataFrame(terms, "term string, idf double, coefficients array<double>"), classes, tuple(float(b) for b in model.interceptVector))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def predict(rows: DataFrame, key: str, tokens: str, model: TextModel) -> DataFrame:
    """(key, label, probability) of every row: the likeliest class, ties to the first, and its softmax; null where no token is known."""
    counts = rows.select(F.col(key).alias("key"), F.explode(tokens).alias("term")).join(F.broadcast(model.terms.select("term")), "term").groupBy("key", "term").count()  # VOCABULARY rows at most
    weighed = counts.join(F.broadcast(model.terms), "term").select("key", ((1 + F.log("count")) * F.col("idf")).alias("w"), "coefficients")
    k = range(len(model.classes))
    sums = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.col("coefficients")[i]).alias(f"s{i}") for i in k))
    scores = F.array(*(F.coalesce(F.col(f"s{i}") / F.nullif("norm", F.lit(0.0)), F.lit(0.0)) + F.lit(b) for i, b in zip(k, model.intercepts, strict=True)))
    powers = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    found = sums.select("key", scores.alias("scores")).select("key", F.get(F.array(*map(F.lit, model.classes)), best - 1).alias("label"), (1.0 / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    return rows.select(F.col(key).alias("key")).join(found, "key", "left")

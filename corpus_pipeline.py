"""The corpus pipeline: quality, near duplicates, decontamination, secrets, mixing.

Each stage takes the documents that its predecessor kept and returns the
columns of documents, the last one with its counts besides.  A row is known by
its doc_id and text, so rows without doc_id are judged as all others are, and
rows with one doc_id and different texts are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.decontaminate import without_leaks
from textloom.llm.jaccard_join import NO_ID, jaccard_groups
from textloom.llm.mixing import mixed
from textloom.llm.quality import quality_scores
from textloom.llm.queries import table
from textloom.llm.secret_scan import secret_scan
from textloom.llm.shared import WORD, written


def aside(docs: DataFrame):
    """``docs`` with all columns but doc_id, text and source under names of their own, and the way back."""
    names = {c: c if c in ("doc_id", "text", "source") else f"_kept{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return moved, lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items())), names


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rows, back, names = aside(docs)
    rest = tuple(n for n in names.values() if n not in ("doc_id", "text"))
    return back(quality_scores(rows, table(spark, sf_dir, "labels"), carry=rest).filter("predicted = 1"))


def same_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that no null hides (_id, _hash) and the number of each row among those that share it (_nth)."""
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_hash": F.xxhash64(F.col("text").cast("string"))})
    order = F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))
    return keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(order)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (one without doc_id where there is no other), and all rows without words."""
    rows, back, _ = aside(docs)
    groups = jaccard_groups(rows).filter("n_shingles > 0").groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    best = groups.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias("_id"), F.col("best.text_hash").alias("_hash"))
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    kept = same_rows(rows.filter(worded)).filter("_nth = 1").join(written(best, "kept"), ["_id", "_hash"], "left_semi")
    return back(kept.drop("_id", "_hash", "_nth").unionByName(rows.filter(~worded)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    rows, back, _ = aside(docs)
    return back(without_leaks(rows, table(spark, sf_dir, "benchmark")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars counts the new text."""
    rows, back, names = aside(docs)
    rest = tuple(n for n in names.values() if n not in ("doc_id", "text"))
    out = secret_scan(rows, redact=True, carry=rest).withColumn("text", F.col("redacted"))
    if "n_chars" in names:
        count = F.col(names["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(count))
    return back(out)


MIX = ("size", "source_size", "target", "copies", "taken")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies) and the words taken; these names win over the documents' own."""
    rows, _, names = aside(docs)
    numbered = same_rows(rows)
    units = mixed(numbered, carry=("_id", "_hash", "_nth")).filter("copies > 0")
    taken = written(units.select("_id", "_hash", "_nth", *MIX), "taken")
    joined = numbered.join(taken, ["_id", "_hash", "_nth"])
    return joined.select(*(F.col(n).alias(c) for c, n in names.items() if c not in MIX), *MIX)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]
#: classifier, latent search and sampling are not SQL; tests/llm compares the stages with plain ones
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

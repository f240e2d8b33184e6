"""Registrable domains by a list of public suffixes, which is a table like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """(kind, suffix) of a list in its published format: a rule a line, // comments, *. for wildcards and ! for exceptions."""
    line = F.lower(F.trim(F.regexp_replace("value", "//.*$", "")))
    rules = spark.read.text(path).select(line.alias("rule")).filter("rule <> ''")
    kind = F.when(F.startswith("rule", F.lit("!")), "except").when(F.startswith("rule", F.lit("*.")), "wild").otherwise("plain")
    return rules.select(kind.alias("kind"), F.regexp_replace("rule", r"^(!|\*\.)", "").alias("suffix")).distinct()


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain) of each distinct host: its public suffix and one label more.

    The tails of a host are joined with the rules.  An exception beats all other
    rules and names a suffix one label shorter than itself; else the longest
    plain rule or wildcard (one label longer than what it names) wins, and
    without any the suffix is the last label.  Null for addresses, for hosts with
    an empty label, and for bare suffixes.
    """
    named = hosts.select(F.col(host).alias("host")).filter("host is not null").distinct()
    labels = F.split(F.regexp_replace(F.lower("host"), r"\.$", ""), r"\.")
    rows = named.withColumn("labels", labels)
    fit = ~F.contains("host", F.lit(":")) & ~F.array_contains("labels", "") & ~F.element_at("labels", -1).rlike("^[0-9]+$")
    tails = rows.filter(fit).select("host", F.size("labels").alias("n"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"), "labels")
    tails = tails.select("host", "n", "k", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("suffix"))
    met = tails.join(rules, "suffix").filter((F.col("kind") != "wild") | (F.col("n") > F.col("k")))
    size = F.when(F.col("kind") == "plain", F.col("k")).when(F.col("kind") == "wild", F.col("k") + 1).otherwise(F.col("k") - 1)
    found = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "except").alias("first"), size.alias("size")))["size"].alias("size"))
    out = rows.join(found, "host", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    domain = F.array_join(F.slice("labels", F.size("labels") - F.col("size"), F.col("size") + 1), ".")
    return out.select("host", F.when(fit & (F.size("labels") > F.col("size")), domain).alias("domain"))

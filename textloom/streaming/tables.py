"""A state table with versions, for streams that change partitions of what they have written.

A version is a small file that names, for each partition, the folder that holds
its rows.  A batch writes folders only for the partitions that it changes, and
then the file of the next version, which keeps the old folders of all others;
so readers see the table before or after a batch and never between.  A version
records the last batch in it, and a batch that comes again (its run failed
after or before the commit) changes nothing or writes the same, so that every
batch counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "part string, folder string, batch long"


class StateTable:
    """``schema`` of the rows, kept in partitions below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _paths(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in store.listStatus(at) if store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if store.exists(at) else []

    def version(self) -> int:
        """The newest whole version; 0 before the first."""
        return max((int(n) for n in self._paths()), default=0)

    def _entries(self, version: int) -> list:
        """A row a partition, and one (part null) for the batch."""
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{version:020d}").collect() if version else []

    def batch(self) -> int:
        """The last batch that is in the table, -1 before the first."""
        return max((r["batch"] for r in self._entries(self.version())), default=-1)

    def folders(self, version: int | None = None) -> dict[str, str]:
        return {r["part"]: r["folder"] for r in self._entries(self.version() if version is None else version) if r["part"] is not None}

    def rows(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, of some partitions or of all."""
        folders = [f for p, f in sorted(self.folders(version).items()) if parts is None or p in set(parts)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, part: Column, batch: int, parts: list[str]) -> None:
        """The next version: the partitions ``parts`` hold what ``rows`` has of them (nothing: they go), the others stay."""
        if batch <= self.batch():
            return
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        columns = rows.columns
        rows.withColumn("_part", part).select("_part", *columns).write.partitionBy("_part").parquet(folder)
        held = {r[0] for r in self.spark.read.schema(f"_part string, {self.schema}").parquet(folder).select("_part").distinct().collect()} if parts else set()  # at most ``parts``
        now = {p: f for p, f in self.folders().items() if p not in set(parts)} | {p: f"{folder}/_part={p}" for p in parts if p in held}
        entries = [(p, f, batch) for p, f in sorted(now.items())] + [(None, None, batch)]
        self.spark.createDataFrame(entries, VERSION).coalesce(1).write.parquet(f"{self.path}/versions/{self.version() + 1:020d}")


def once(table: StateTable, build: Callable[[DataFrame, StateTable], tuple[DataFrame, Column, list[str]]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``build`` gives the new rows, their partition and which partitions are replaced; a batch that is in the table is left out."""

    def save(batch: DataFrame, number: int) -> None:
        if number <= table.batch():
            return
        rows, part, parts = build(batch, table)
        table.replace(rows, part, number, parts)

    return save


WEEKS = "week date, key long, first date, returned boolean"


def snapshots(batch: DataFrame, table: StateTable) -> tuple[DataFrame, Column, list[str]]:
    """Weekly snapshots (week, key) against what the weeks before hold: when a key was first seen, and whether the week before has it.

    A week that comes late is measured in its place, and the weeks after it are
    measured again where it changes them: the week next to it, and those that
    hold a key which was first seen later than in it.  All other partitions stay.
    """
    spark = batch.sparkSession
    new = batch.select(F.col("week").cast("date").alias("week"), F.col("key").cast("long").alias("key")).distinct()
    arrived = sorted(r[0] for r in new.select("week").distinct().collect())  # weeks of a batch
    if not arrived:
        return spark.createDataFrame([], WEEKS), F.lit(""), []
    known = table.rows()
    have = sorted({p for p in table.folders()} | {str(w) for w in arrived})
    seen = known.groupBy("key").agg(F.min("first").alias("was"))
    earlier = new.groupBy("key").agg(F.min("week").alias("came")).join(seen, "key", "left").filter(F.col("was").isNull() | (F.col("came") < F.col("was")))
    touched = {r[0] for r in known.join(earlier.select("key"), "key", "left_semi").select(F.col("week").cast("string")).distinct().collect()}  # weeks at most
    after = {have[i + 1] for i, w in enumerate(have[:-1]) if w in {str(a) for a in arrived}}
    parts = sorted({str(w) for w in arrived} | touched | after)
    again = known.filter(F.col("week").cast("string").isin(parts)).select("week", "key").unionByName(new).distinct()
    firsts = seen.join(new.groupBy("key").agg(F.min("week").alias("came")), "key", "full").select("key", F.least("was", "came").alias("first"))
    before = {w: have[i - 1] if i else None for i, w in enumerate(have)}
    pairs = spark.createDataFrame([(w, before[w]) for w in parts], "w string, before string").select(F.col("w").cast("date").alias("week"), F.col("before").cast("date").alias("before"))
    needed = sorted({b for w in parts if (b := before[w])})
    held = table.rows(needed).select("week", "key").unionByName(new).distinct().select(F.col("week").alias("before"), "key", F.lit(True).alias("_held"))
    out = again.join(F.broadcast(pairs), "week").join(firsts, "key").join(held, ["before", "key"], "left")  # a row a week
    out = out.select("week", "key", "first", F.coalesce("_held", F.lit(False)).alias("returned"))
    return out, F.col("week").cast("string"), parts


def placed_once(batch: DataFrame, table: StateTable, buckets: int = 16) -> tuple[DataFrame, Column, list[str]]:
    """Rows whose key the table does not hold, placed into it: (key, batch columns) in partitions by hash, of which only those met are read and written."""
    part = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string")
    new = batch.dropDuplicates(["key"]).withColumn("_b", part)
    met = sorted(r[0] for r in new.select("_b").distinct().collect())  # buckets at most
    known = table.rows(met)
    rows = known.unionByName(new.drop("_b").join(known.select("key"), "key", "left_anti"))
    return rows, part, met

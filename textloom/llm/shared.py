"""Helpers shared by the training-data operators: shared storage and sizes."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every separator of the contracts: space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) is a local one set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{_own(spark)}/{uuid.uuid4().hex}/{name}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once no result is read from it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts lineage without tying rows to one executor's memory or disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def sized_filters(spark: SparkSession):
    """For joins that carry texts.

    Spark may filter the large side by a Bloom filter of the small one, whose
    size it checks first, and passes texts to Python in small batches.
    """
    wanted = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0b", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the texts that one Arrow batch holds, unless the session already asks for fewer rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


def buckets_for(df: DataFrame, amount: float, each: float) -> int:
    """Groups of about ``each``, and as many as the session has shuffle partitions at least."""
    return max(parts_for(amount, each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parts_for(amount: float, each: float) -> int:
    """How many groups of about ``each`` cover ``amount``; one at least."""
    return max(1, math.ceil(amount / each))

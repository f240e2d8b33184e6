"""A search under a time budget, and its continuation.

The rows are cut into ordered ranges of (part, key): a part is a group of input
files, and where there are fewer files than ranges, each part is cut again by
quantiles of the key, so that file statistics prune the rest.  Each range is
searched by a Spark job of its own, in a job group that is cancelled at the
deadline.  A range counts as done when its record is in the cursor table, which
is written after its result; an attempt that was cancelled leaves no record and
its files are never read.  So a search that was stopped gives the ranges done
and a cursor, and one that is continued gives each range once.

A cursor is bound to what was asked and to the files: it refuses to continue
another search.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.storage import shared_folder

RANGES = "range int, part int, low long, high long"
DONE = "range int, attempt string"


class WrongCursor(ValueError):
    """The cursor belongs to another search, or to other files."""


@dataclass(frozen=True)
class Cursor:
    """Where a search keeps its ranges and what it has done."""

    folder: str
    asked: str


def _digest(asked: str, files: list[str]) -> str:
    return hashlib.sha256(json.dumps([asked, files]).encode()).hexdigest()


def _parts(files: list[str], ranges: int) -> list[list[str]]:
    """Files in order, dealt to at most ``ranges`` groups."""
    n = max(1, min(ranges, len(files)))
    return [files[len(files) * i // n : len(files) * (i + 1) // n] for i in range(n)]


def begin(df: DataFrame, key: str, asked: str, ranges: int = 16) -> Cursor:
    """Cut the rows of ``df`` (read from files) into about ``ranges`` ranges and store them."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    parts = _parts(files, ranges)
    each = max(1, ranges // len(parts))
    rows: list[tuple] = []
    for part in range(len(parts)):
        cuts: list[int] = []
        if each > 1:  # then there are fewer files than ranges
            at = spark.read.schema(df.schema).parquet(*parts[part]).agg(F.percentile_approx(F.col(key).cast("long"), [i / each for i in range(1, each)], 10_000)).first()[0]
            cuts = sorted(set(at or []))
        rows += [(len(rows) + i, part, low, high) for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))]
    folder = f"{shared_folder(spark)}/search/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, RANGES).coalesce(1).write.parquet(f"{folder}/ranges")
    spark.createDataFrame([], DONE).write.parquet(f"{folder}/done")
    return Cursor(folder, _digest(asked, files))


def finished(spark: SparkSession, cursor: Cursor) -> dict[int, str]:
    """The attempt that counts of each range that is done; a row a range."""
    return {r["range"]: r["attempt"] for r in spark.read.schema(DONE).parquet(f"{cursor.folder}/done").collect()}


def _in_range(df: DataFrame, key: str, low: int | None, high: int | None) -> DataFrame:
    """Rows of [low, high); rows without a key are in the first range of their part."""
    k = F.col(key).cast("long")
    if low is None:
        return df if high is None else df.filter((k < high) | k.isNull())
    return df.filter(k >= low) if high is None else df.filter((k >= low) & (k < high))


def advance(df: DataFrame, key: str, cursor: Cursor, asked: str, search: Callable[[DataFrame], DataFrame], budget: float | None, clock: Callable[[], float] = time.monotonic) -> bool:
    """Search the ranges that are open, in order, until the budget (seconds; None: without end) is spent.  True when all are done."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if _digest(asked, files) != cursor.asked:
        raise WrongCursor("the cursor is of another search")
    todo = spark.read.schema(RANGES).parquet(f"{cursor.folder}/ranges").orderBy("range").collect()
    parts = _parts(files, len({r["part"] for r in todo}))
    done, deadline = finished(spark, cursor), None if budget is None else clock() + budget
    for r in todo:
        if r["range"] in done:
            continue
        left = None if deadline is None else deadline - clock()
        if left is not None and left <= 0:
            return False
        rows = _in_range(spark.read.schema(df.schema).parquet(*parts[r["part"]]), key, r["low"], r["high"])
        attempt = uuid.uuid4().hex
        if not _within(spark, left, lambda rows=rows, attempt=attempt: search(rows).write.parquet(f"{cursor.folder}/found/{attempt}")):
            return False
        spark.createDataFrame([(r["range"], attempt)], DONE).coalesce(1).write.mode("append").parquet(f"{cursor.folder}/done")
    return True


def _within(spark: SparkSession, seconds: float | None, job: Callable[[], None]) -> bool:
    """Run a job in a group of its own, cancelled after ``seconds``; whether it came to its end."""
    context, group, late = spark.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = None if seconds is None else threading.Timer(seconds, stop)
    before = {name: context.getLocalProperty(name) for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, "a range of a search", interruptOnCancel=True)
    if timer:
        timer.start()
    try:
        job()
        return True
    except Exception:
        if late.is_set():
            return False
        raise
    finally:
        if timer:
            timer.cancel()
        for name, value in before.items():
            context.setLocalProperty(name, value)


def found(spark: SparkSession, cursor: Cursor, schema) -> DataFrame:
    """What the ranges done so far have given."""
    paths = [f"{cursor.folder}/found/{attempt}" for _, attempt in sorted(finished(spark, cursor).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

"""Page layout of extracted lines: running heads, page numbers, hyphenated line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def body_lines(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, page, line, text) without running heads and page numbers.

    A first or last line is a running head when, with its digits masked, it is
    first or last on at least ``share`` of its document's pages (two at least).
    """
    w = Window.partitionBy("doc", "page")
    marked = lines.withColumns({"edge": (F.col("line") == F.min("line").over(w)) | (F.col("line") == F.max("line").over(w)), "mask": F.regexp_replace(F.trim("text"), "[0-9]+", "#")})
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    heads = marked.filter("edge").groupBy("doc", "mask").agg(F.count_distinct("page").alias("on")).join(pages, "doc")
    heads = heads.filter((F.col("on") >= 2) & (F.col("on") >= F.col("pages") * share)).select("doc", "mask", F.lit(True).alias("edge"))
    rest = marked.join(heads, ["doc", "mask", "edge"], "left_anti")
    return rest.filter(~(F.col("edge") & F.trim("text").rlike("^[0-9]+$"))).select("doc", "page", "line", "text")


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc, text): lines in order, a hyphen at a line's end joined to the next line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "line", "text")))
    whole = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return lines.groupBy("doc").agg(F.regexp_replace(F.regexp_replace(whole, "([a-z])-\n([a-z])", "$1$2"), "\n", " ").alias("text"))

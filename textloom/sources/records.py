"""Record sources and sinks: JSON lines, CSV, feeds, manifests, inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import words
from textloom.sources.tail import TailSource


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a line that does not fit the schema stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines and, apart from them, the lines that do not fit, with their file."""
    fields = T.StructType.fromDDL(schema)
    full = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("_file"), parsed.alias("r"))
    return lines.filter("r._bad is null").select(*(F.col(f"r.{f.name}") for f in fields)), lines.filter("r._bad is not null").select("_file", "r._bad")


class BadLine(ValueError):
    """A line of a log that does not fit its schema, by file and number."""


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text): of each log of JSON lines the first line that does not fit.

    Lines are read with their byte offsets, in ranges; a line's number is how
    many lines begin before it in its log, and only first bad lines are numbered.
    """
    spark.dataSource.register(TailSource)
    lines = spark.read.format("tail").option("path", path).load()
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    wrong = lines.filter(F.trim("line") != "").select("file", "at", "line", parsed["_bad"].isNotNull().alias("bad")).filter("bad")
    first = wrong.groupBy("file").agg(F.min("at").alias("bad_at"), F.min_by("line", "at").alias("text"))
    before = lines.select("file", "at").join(first, "file").filter("at <= bad_at")
    return before.groupBy("file", "text").agg(F.count("*").alias("line")).select("file", "line", "text")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines whose every line fits; else the read is refused, and the error names file and line."""
    wrong = bad_lines(spark, path, schema).orderBy("file").first()
    if wrong:
        raise BadLine(f"{wrong['file']}: line {wrong['line']} does not fit: {wrong['text'][:80]}")
    return read_jsonl(spark, path, schema)


def manifest_lines(rows: DataFrame, order: str) -> DataFrame:
    """One canonical JSON text per row (columns by name), in order of a key."""
    return rows.select(order, F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line")).orderBy(order)


def write_csv(rows: DataFrame, path: str, order: list) -> None:
    """CSV files with a header each, in the given order from file to file (ranges of it, not one task)."""
    rows.orderBy(*order).write.option("header", "true").option("escape", '"').csv(path, mode="overwrite")


def read_decisions(spark: SparkSession, path: str, schema: str, key: str, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Decisions of a CSV file, and the rows refused: no key, a repeated key, or a value that is not allowed."""
    rows = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    repeated = rows.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias("again"))
    wrong = F.lit(False)
    for column, values in allowed.items():
        wrong = wrong | ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    marked = rows.join(repeated, key, "left").withColumn("problem", F.when(F.col(key).isNull(), "no key").when(F.col("again"), "repeated key").when(wrong, "value"))
    return marked.filter("problem is null").select(*rows.columns), marked.filter("problem is not null").select(*rows.columns, "problem")


#: a feed's first line: only XML 1.1 can refer to control characters
XML_HEAD = '<?xml version="1.1"?>'


def xml_escaped(text: Column) -> Column:
    """``text`` as it stands inside an element or a quoted attribute of XML 1.1; white space, line ends and control characters become references, so that a parser changes none."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    control = r"[\x01-\x1F\x7F-\x9F\u2028]"
    signs = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda x: F.when(x.rlike(control), F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(x))
    return F.when(text.rlike(control), F.array_join(signs, "")).otherwise(text)


def feed_entries(feeds: DataFrame, key: str, xml: str, trim: bool = True) -> DataFrame:
    """Entries of RSS and Atom documents held in a column: (key, position, title, link, published, snippet).

    Of an Atom entry's links that with no rel or rel alternate counts; published
    before updated, summary before content.  ``trim``: white space around a text
    is dropped.
    """
    options = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": str(trim).lower()}
    item = "struct<title:string,link:string,pubDate:string,description:string>"
    entry = "struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string,content:string>"
    rss = F.from_xml(F.col(xml), f"channel struct<title:string,item:array<{item}>>", options)
    atom = F.from_xml(F.col(xml), f"title string, entry array<{entry}>", options)
    href = lambda e: F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    one = lambda title, link, at, text: F.struct(title.alias("title"), link.alias("link"), at.alias("published"), text.alias("snippet"))
    of_rss = F.transform(F.col("r.channel.item"), lambda e: one(e["title"], e["link"], e["pubDate"], e["description"]))
    of_atom = F.transform(F.col("a.entry"), lambda e: one(e["title"], href(e), F.coalesce(e["published"], e["updated"]), F.coalesce(e["summary"], e["content"])))
    rows = feeds.select(key, rss.alias("r"), atom.alias("a")).select(key, F.posexplode(F.coalesce(of_rss, of_atom)).alias("position", "e"))
    return rows.select(key, "position", "e.*")


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", parts: int = 64) -> None:
    """Inverted index as Parquet: postings (term, key, tf, positions) in folders by the term's hash; ranges of (part, term, key), so that a common term is many tasks."""
    tokens = docs.select(key, F.posexplode(words(F.col(text))).alias("at", "term"))
    postings = tokens.groupBy("term", key).agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
    dealt = postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    dealt.repartitionByRange("part", "term", key).sortWithinPartitions("part", "term", key).write.partitionBy("part").mode("overwrite").parquet(path)


def search_index(spark: SparkSession, path: str, terms: list[str], parts: int = 64) -> DataFrame:
    """Postings of the terms; only their parts of the index are read."""
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"))
    keep = [r[0] for r in wanted.select("part").distinct().collect()]  # as many as terms at most
    return spark.read.parquet(path).filter(F.col("part").isin(*keep) & F.col("term").isin(*terms)).drop("part")

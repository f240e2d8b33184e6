"""WARC archives: one transaction of three records a page, written, read back and assembled.

Writing: every page gives a response record (or a revisit of the response
with the same payload), a request and a metadata record; the latter two name
the first in WARC-Concurrent-To.  A WARC record ends in two line ends, so
Spark's own text writer, with that separator and gzip, writes valid archives
to any store Spark can write.  Revisits are found on digests alone.

Reading: Spark reads whole files (bounded by bytes when written), records are
cut by their Content-Length, payload digests are computed anew.  Assembly joins
request and metadata to their response through the concurrent-to identifier
and nests the three into one row per capture.  A revisit finds the page of its
response through the record that it refers to.

Cases: a null payload is empty; payloads under 1000 bytes are never revisits;
pages that repeat with the same page_id and payload are each a capture, all of
the kind that their page_id has; a null page_id is smaller than any other and
stays null; a null url is written empty; line ends in a url are written as
spaces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.shared import buckets_for, written

LEAST = 1000
#: bytes of payloads and records that one archive holds about
FILE_BYTES, RECORDS_A_FILE = 64 << 20, 12_000
END = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null headers are left out by concat_ws
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of (page_id, url, html) at ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html")})
    keys = rows.filter(F.col("bytes") >= LEAST).select("page_id", "digest")
    lead = keys.groupBy("digest").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = keys.join(lead, "digest").filter(~F.col("page_id").eqNullSafe(F.col("lead"))).distinct()
    # one key for the join and the window, so that payloads are shuffled once
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")
    revisits = revisits.select(key.alias("key"), "lead", F.lit(True).alias("again"))
    held = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0))).first()
    files, each = buckets_for(rows, held[1], FILE_BYTES), held[1] / max(1, held[0]) + 1
    rows = rows.withColumn("key", key).repartition(files, "key").join(revisits, "key", "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("url")))
    again = F.col("again").isNotNull()
    own, digest = _uuid(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("nth")), F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    response = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), own, date,
        [
            ("WARC-Target-URI", F.col("url")), ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(again, _uuid(F.lit("capture"), F.col("lead"), F.col("digest"), F.lit(1)))),
        ],
        F.when(again, head).otherwise(F.concat(head, F.col("html"))),
    )
    target = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    request = _record(
        F.lit("request"), _uuid(F.lit("request"), own), date, [("WARC-Target-URI", F.col("url")), ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", own)],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-length: "), F.col("bytes").cast("string")))
    metadata = _record(
        F.lit("metadata"), _uuid(F.lit("metadata"), own), date, [("WARC-Target-URI", F.col("url")), ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", own)], fields
    )
    records = rows.select(F.explode(F.array(response, request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(3, min(RECORDS_A_FILE, 3 * int(2 * FILE_BYTES / each)))).text(path)


RECORD = "record_id string, kind string, concurrent_to string, refers_to string, url string, digest string, payload_bytes long, payload string, fields map<string,string>"


def records_of(data: bytes) -> Iterator[dict]:
    """The records of one decompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        yield {"head": head, "block": block}
        at = stop + 4 + length + 4


def inflate(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out)


def _parse(payloads: bool):
    kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in records_of(inflate(content.as_py())):
                    head, block = r["head"], r["block"]
                    row = {"record_id": head["warc-record-id"], "kind": head["warc-type"], "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "url": head.get("warc-target-uri")}
                    if row["kind"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        row |= {"digest": hashlib.sha1(body).hexdigest(), "payload_bytes": len(body), "payload": body.decode("utf-8") if payloads else None}
                    elif row["kind"] == "revisit":
                        row["digest"] = head["warc-payload-digest"].partition(":")[2]
                    elif row["kind"] == "metadata":
                        row["fields"] = [(k, v) for k, _, v in (x.partition(": ") for x in block.decode("utf-8").split("\r\n")) if k]
                    elif row["kind"] == "request":
                        row["fields"] = [("request-line", block.split(b"\r\n", 1)[0].decode("utf-8"))]
                    rows.append(row)
                    if len(rows) == 2000:
                        yield from pa.Table.from_pylist(rows, schema=kind).to_batches()
                        rows = []
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=kind).to_batches()

    return parse


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives at ``path``; without payloads only their size and digest are kept."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(payloads), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: its response (or revisit), request and metadata, joined by concurrent-to and nested."""
    main = records.filter(F.col("kind").isin("response", "revisit"))
    parts = records.filter(F.col("kind").isin("request", "metadata"))
    other = parts.groupBy(F.col("concurrent_to").alias("to")).agg(
        F.min(F.when(F.col("kind") == "request", F.struct("record_id", F.element_at("fields", "request-line").alias("line")))).alias("request"),
        F.min(F.when(F.col("kind") == "metadata", F.struct("record_id", F.element_at("fields", "page-id").cast("long").alias("page_id"), F.element_at("fields", "payload-length").cast("long").alias("payload_length")))).alias("metadata"),
    )
    joined = main.join(other, main["record_id"] == other["to"], "left")
    return joined.select(
        "record_id", "url", F.struct("kind", "digest", "payload_bytes", "payload", "refers_to").alias("response"), "request", "metadata"
    )


def page_captures(rows: DataFrame) -> DataFrame:
    """The digest columns of assembled captures: one row per page."""
    rows = rows.select(
        "record_id",
        F.col("response.refers_to").alias("target"),
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
    )
    rows = written(rows, "captures")
    named = rows.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    return rows.drop("record_id").join(named, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS lead FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> m.lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> m.lead THEN m.lead END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

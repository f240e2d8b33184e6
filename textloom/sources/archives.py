"""Archive sources: members of zip files, and paragraphs and runs of DOCX files, one task a file."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBERS = "archive string, member string, size long, sha256 string, skipped string"
JUNK = ("__MACOSX/", ".DS_Store", "Thumbs.db")


def _reason(info: zipfile.ZipInfo, unpacked: int, limit: int) -> str | None:
    """Why a member is not read, if it isn't."""
    name = info.filename
    if info.is_dir():
        return "folder"
    if name.startswith("/") or ".." in name.split("/"):
        return "escapes"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "link"
    if any(name.startswith(j) or name.endswith(j) for j in JUNK):
        return "junk"
    return "too large" if unpacked + info.file_size > limit else None


def zip_members(spark: SparkSession, path: str, limit: int = 1 << 30) -> DataFrame:
    """Members of every zip file in path order, with their digests or the reason for skipping them.

    ``limit`` bounds what one archive unpacks to; members are hashed in pieces.
    """
    return members_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path), limit)


def members_of(files: DataFrame, limit: int = 1 << 30) -> DataFrame:
    """The same for files in hand: path, content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, unpacked = [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        why = _reason(info, unpacked, limit)
                        digest = None
                        if why is None:
                            unpacked += info.file_size
                            h = hashlib.sha256()
                            with z.open(info) as f:
                                while piece := f.read(1 << 20):
                                    h.update(piece)
                            digest = h.hexdigest()
                        rows.append((name.rsplit("/", 1)[-1], info.filename, info.file_size, digest, why))
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256", "skipped"])

    return files.select("path", "content").mapInPandas(read, MEMBERS)


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "file string, paragraph int, style string, text string, runs array<struct<start:int,end:int,style:string>>"
#: fixed values: run properties that count as formatting
MARKS = (("b", "bold"), ("u", "underline"), ("highlight", "highlight"))


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of DOCX files in order, with the formatting of their runs as spans of characters."""
    return paragraphs_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path))


def paragraphs_of(files: DataFrame) -> DataFrame:
    """The same for files in hand: path, content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                rows = []
                for i, p in enumerate(root.iter(f"{W}p")):
                    style, text, runs = p.find(f"{W}pPr/{W}pStyle"), "", []
                    for r in p.iter(f"{W}r"):
                        part = "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in r)
                        held = r.find(f"{W}rPr")
                        for tag, mark in MARKS:
                            e = held.find(f"{W}{tag}") if held is not None else None
                            if part and e is not None and e.get(f"{W}val", "true") not in ("0", "false", "none"):
                                runs.append({"start": len(text), "end": len(text) + len(part), "style": mark})
                        text += part
                    rows.append((name.rsplit("/", 1)[-1], i, style.get(f"{W}val") if style is not None else None, text, runs))
                yield pd.DataFrame(rows, columns=["file", "paragraph", "style", "text", "runs"])

    return files.select("path", "content").mapInPandas(read, PARAGRAPHS)


@F.pandas_udf(T.BinaryType())
def zipped(names: pd.Series, texts: pd.Series) -> pd.Series:
    """A zip file with one member a row, its time fixed so that equal rows give equal bytes."""
    def one(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
        return out.getvalue()

    return pd.Series([one(n, t) for n, t in zip(names, texts, strict=True)])

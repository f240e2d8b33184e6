"""Decoding of bodies by their byte order mark, their header or what they say themselves, strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: names of the encodings that are read, and bytes in which a page may name its own
NAMES = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
HEAD = 1024
MARKS = {"EFBBBF": ("UTF-8", 3), "FFFE": ("UTF-16LE", 2), "FEFF": ("UTF-16BE", 2)}
CHARSET = r"""(?i)charset\s*=\s*["']?\s*([a-z0-9_.:-]+)"""


def _named(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, CHARSET, 1)), F.lit(""))


def charset_of(body: Column, header: Column) -> Column:
    """struct(charset, skip, source): a mark at the beginning, else the header's charset, else a meta element's in the first bytes, else UTF-8; charset is null for a name that is not read."""
    head = F.decode(F.substring(body, 1, HEAD), "ISO-8859-1")
    meta = _named(F.regexp_extract(head, r"(?is)<meta[^>]*charset[^>]*>", 0))
    table = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    known = lambda name, source: F.struct(F.try_element_at(table, name).alias("charset"), F.lit(0).alias("skip"), F.lit(source).alias("source"))
    out = F.when(_named(header).isNotNull(), known(_named(header), "header")).when(meta.isNotNull(), known(meta, "meta")).otherwise(known(F.lit("utf-8"), "default"))
    for mark, (name, size) in reversed(MARKS.items()):
        out = F.when(F.hex(F.substring(body, 1, size)) == mark, F.struct(F.lit(name).alias("charset"), F.lit(size).alias("skip"), F.lit("mark").alias("source"))).otherwise(out)
    return out


def decoded(body: Column, charset: Column) -> Column:
    """struct(text, problem): the text of a body under ``charset_of``, or why it has none. Nothing is replaced: a byte that does not fit refuses the body."""
    rest = F.substring(body, charset["skip"] + 1, F.octet_length(body).cast("int"))
    name = charset["charset"]
    utf8 = F.try_validate_utf8(rest.cast("string"))
    ascii_ = F.when(~F.decode(rest, "ISO-8859-1").rlike("[^\\x00-\\x7F]"), F.decode(rest, "ISO-8859-1"))
    wide = F.when(F.octet_length(rest) % 2 == 0, F.when(name == "UTF-16LE", F.decode(rest, "UTF-16LE")).otherwise(F.decode(rest, "UTF-16BE")))
    text = F.when(name == "UTF-8", utf8).when(name == "US-ASCII", ascii_).when(name == "ISO-8859-1", F.decode(rest, "ISO-8859-1")).when(name.startswith("UTF-16"), wide)
    problem = F.when(body.isNull(), "no body").when(name.isNull(), "unknown charset").when(text.isNull(), "malformed")
    return F.struct(text.alias("text"), problem.alias("problem"))

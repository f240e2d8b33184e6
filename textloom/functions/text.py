"""Column expressions over text: matching normalisation, words, shingles, tags, headings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: characters that matching treats alike, and those it drops
QUOTES = "‘’‚‛′´`"
DOUBLE_QUOTES = "“”„‟″«»"
DASHES = "‐‑‒–—―−"
#: fixed values: the space separators of Unicode, which SQL trims
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "­​‌‍⁠﻿"


def trimmed(text: Column) -> Column:
    """``text`` without space separators at its ends; other white space stays."""
    return F.trim(text, F.lit(SPACES))


def normalize_ascii(text: Column) -> Column:
    """Matching form by built-in functions: lower case, quotes and dashes unified, invisible characters dropped, spaces collapsed."""
    same = F.translate(text, QUOTES + DOUBLE_QUOTES + DASHES + INVISIBLE, "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(F.lower(same), r"[\s  ]+", " "))


_TABLE = {**{ord(c): "'" for c in QUOTES}, **{ord(c): '"' for c in DOUBLE_QUOTES}, **{ord(c): "-" for c in DASHES}, **{ord(c): None for c in INVISIBLE}}


def normalized(text: str | None) -> str | None:
    """Matching form with Unicode compatibility composition and full case folding."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).casefold().translate(_TABLE).split())


@F.pandas_udf(T.StringType())
def normalize_for_matching(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(normalized, na_action="ignore")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalize_ascii(text), 256)


def card_fingerprint(body: Column, cite: Column, completeness: Column) -> Column:
    """The body's fingerprint, or that of the cite line, kept apart by a prefix, when only a cite is there."""
    return F.when(completeness == "CITE_ONLY", F.sha2(F.concat(F.lit("cite-line\u0000"), normalize_ascii(cite)), 256)).otherwise(fingerprint(body))


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "), " "), lambda x: x != "")


def tag_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def matching_words(text: Column) -> Column:
    """Words of the matching form, after joining words that a line break hyphenated."""
    return F.regexp_extract_all(F.regexp_replace(normalize_ascii(text), "([0-9a-z_])- ([0-9a-z_])", "$1$2"), F.lit(r"(\w+)"))


def word_runs(tokens: Column, k: int) -> Column:
    """Every run of k words, in order. Zips k shifted copies, so an expression for the words is not repeated a word."""
    n = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(tokens, i + 1, n) for i in range(k)))
    return F.transform(shifted, lambda x: F.concat_ws(" ", *(x[str(i)] for i in range(k))))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct k-word runs; the whole text when it is shorter, nothing when it is empty."""
    short = F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(tokens, " ")))
    return F.when(F.size(tokens) < k, short).otherwise(F.array_distinct(word_runs(tokens, k)))


def cutter_mark(body: Column, longest: int = 20) -> Column:
    """The token after // that ends the last line that is not blank, unless a colon precedes it."""
    last = F.element_at(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), -1)
    mark = F.regexp_extract(last, r"(?:^|[^:])//[ ]*([A-Za-z0-9]+)[ ]*$", 1)
    return F.when((mark != "") & (F.length(mark) <= longest), mark)


def short_cite_key(cite: Column) -> Column:
    """A cite's key: matching form without punctuation, four-digit years as two digits."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(normalize_ascii(cite), "[^0-9a-z ]+", " "), " +", " "))
    return F.regexp_replace(plain, r"\b(?:19|20)([0-9]{2})\b", "$1")


def heading(text: Column) -> Column:
    """struct(text, answer): numbering, round prefixes, answer markers and dashes removed."""
    plain = F.trim(F.regexp_replace(normalize_ascii(text), "^(?:[0-9]+[.)]|[0-9]?(?:ac|nc|ar|nr)[ :-])[ ]*", ""))
    marker = r"^(?:a2|at|answers? to|ans)[ :-]+"
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, marker, ""), r"[ ]*-+[ ]*", " "))
    return F.struct(bare.alias("text"), plain.rlike(marker).alias("answer"))


def heading_anchor(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " ")), " ", "-")


def redacted(text: Column) -> Column:
    """Credentials and keys replaced by a mark."""
    out = F.regexp_replace(text, r"(?i)(password|passwd|secret|token|api_?key)([ ]*[:=][ ]*)[^ \n]+", "$1$2[redacted]")
    out = F.regexp_replace(out, r"AKIA[A-Z0-9]{16}", "[redacted]")
    return F.regexp_replace(out, r"(?i)bearer [a-z0-9._-]+", "Bearer [redacted]")


#: fixed values: British spellings that ranking treats as American
SPELLINGS = {"labour": "labor", "colour": "color", "defence": "defense", "programme": "program", "centre": "center", "organisation": "organization"}


def ranking_tokens(text: Column) -> Column:
    """Tokens for ranking: possessives dropped, letters joined across ' and ., American spelling."""
    plain = F.regexp_replace(F.lower(text), "'s([^0-9a-z]|$)", "$1")
    joined = F.regexp_replace(plain, "([a-z])['.]([a-z])", "$1$2")
    tokens = F.filter(F.split(F.regexp_replace(joined, "[^0-9a-z]+", " "), " "), lambda x: x != "")
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.transform(tokens, lambda x: F.coalesce(F.try_element_at(table, x), x))

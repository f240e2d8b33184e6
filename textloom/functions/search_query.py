"""The full-text query grammar, read once at plan time and applied as column predicates.

Words are all required; "phrases" stand in order; ``-`` excludes; ``tag:`` and
``author:`` look in one field; ``stem*`` is a prefix of three letters at least.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import words

MOST_TERMS, MOST_CHARACTERS, LEAST_PREFIX = 32, 512, 3
FIELDS = ("tag", "author")
TERM = re.compile(r'(-?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False
    excluded: bool = False
    prefix: bool = False
    field: str | None = None


class QueryRefused(ValueError):
    """A query that the grammar does not allow."""


def parse(raw: str) -> list[Term]:
    if len(raw) > MOST_CHARACTERS:
        raise QueryRefused("too long")
    out = []
    for minus, field, phrase, word in TERM.findall(raw):
        if field and field.lower() not in FIELDS:
            word, field = f"{field} {word or phrase}", ""
        prefix = bool(word) and word.endswith("*")
        text = " ".join(re.findall(r"[0-9a-z]+", (phrase or word).lower()))
        if not text:
            continue
        if prefix and len(text) < LEAST_PREFIX:
            raise QueryRefused("prefix too short")
        out.append(Term(text, bool(phrase) or " " in text, bool(minus), prefix, field.lower() or None))
    if len(out) > MOST_TERMS:
        raise QueryRefused("too many terms")
    if out and all(t.excluded for t in out):
        raise QueryRefused("nothing to look for")
    return out


def matches(terms: list[Term], fields: dict[str, Column]) -> Column:
    """Whether a row matches; ``fields`` names the texts to look in, and a term without a field looks in all of them."""
    joined = {n: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")) for n, c in fields.items()}
    out = F.lit(True)
    for t in terms:
        where = [joined[t.field]] if t.field else list(joined.values())
        hit = F.lit(False)
        for text in where:
            hit = hit | text.contains(f" {t.text}" if t.prefix else f" {t.text} ")
        out = out & (~hit if t.excluded else hit)
    return out

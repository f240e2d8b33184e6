"""Pages of a ranked result, with a cursor that belongs to one search."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame


class WrongCursor(ValueError):
    """The cursor is no cursor, or of another search."""


def _digest(asked: str, rows: DataFrame) -> str:
    return hashlib.sha256(json.dumps([asked, sorted(rows.inputFiles()), rows.columns]).encode()).hexdigest()[:32]


def encoded(asked: str, rows: DataFrame, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([_digest(asked, rows), offset]).encode()).decode()


def decoded(asked: str, rows: DataFrame, cursor: str) -> int:
    """The offset of a cursor; refused unless it is of this search over these files."""
    try:
        digest, offset = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise WrongCursor("this is no cursor") from e
    if digest != _digest(asked, rows) or not isinstance(offset, int) or offset < 0:
        raise WrongCursor("the cursor is of another search")
    return offset


def page(rows: DataFrame, order: list[Column], size: int, asked: str, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """The next ``size`` rows in a total order, and the cursor of what follows (None at the end).

    ``asked`` names query and filters.  One row more than the page tells whether
    there is a next one; Spark keeps the first offset + size + 1 of each task only.
    """
    offset = decoded(asked, rows, cursor) if cursor else 0
    more = rows.orderBy(*order).offset(offset + size).limit(1).count()
    return rows.orderBy(*order).offset(offset).limit(size), encoded(asked, rows, offset + size) if more else None

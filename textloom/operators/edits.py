"""Edits of a quotation: what may be done to one, and what an allowed one leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import intervals as I

#: fixed values: kinds that re-cut or mark a quotation, kinds beside it, and kinds that are never allowed
RECUT = ("DELETE_RANGE", "SET_MARKUP", "ADD_INTERPOLATION", "REMOVE_INTERPOLATION")
BESIDE = ("EDIT_TAG", "EDIT_CITE")
FORBIDDEN = ("INSERT", "SUBSTITUTE", "MOVE")


def refusal(kind: Column, start: Column, end: Column, length: Column, interpolations: Column) -> Column:
    """Why an edit of a quotation of ``length`` characters is refused, null where it is allowed.

    Quoted words are never added, changed or moved.  A deletion is a range
    inside the quotation that leaves some of it, and no interpolation (an offset)
    stands inside it.
    """
    inside = (start >= 0) & (start < end) & (end <= length)
    blocked = F.exists(interpolations, lambda at: (at > start) & (at < end))
    deletes = kind == "DELETE_RANGE"
    return (
        F.when(kind.isNull() | ~kind.isin(*RECUT, *BESIDE, *FORBIDDEN), "UNKNOWN")
        .when(kind.isin(*FORBIDDEN), "FORBIDDEN")
        .when(deletes & ~F.coalesce(inside, F.lit(False)), "OUT_OF_RANGE")
        .when(deletes & (end - start == length), "NOTHING_LEFT")
        .when(deletes & F.coalesce(blocked, F.lit(False)), "INTERPOLATION")
    )


def without(text: Column, start: Column, end: Column) -> Column:
    """A quotation without [start, end)."""
    return F.concat(F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text)))


def marks_without(marks: Column, start: Column, end: Column) -> Column:
    """Marks on what is left of a quotation: those parts that lie outside [start, end), moved; parts that now touch are one."""

    def moved(at: Column) -> Column:
        return F.when(at <= start, at).when(at >= end, at - (end - start)).otherwise(start).cast("int")

    cut = F.transform(marks, lambda m: F.struct(moved(m["start"]).alias("start"), moved(m["end"]).alias("end")))
    return I.union(F.filter(cut, lambda m: m["start"] < m["end"]))

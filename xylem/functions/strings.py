"""XPath's string functions as column expressions over converted arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(at > 1, F.substring(a, F.lit(1), at - 1)).otherwise("")


def after(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(F.length(b) == 0, a).when(at > 0, F.substring(a, at + F.length(b), F.length(a))).otherwise("")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a 1-based position, truncated; a start below 1 or NaN, or a length of 0 or less or NaN, gives ''."""
    bad = F.isnan(start) | (start < 1)
    room = F.lit(2.0**31 - 2)
    if length is None:
        size = F.length(s)
    else:
        bad = bad | F.isnan(length) | (length <= 0)
        size = F.least(length, room).cast("int")
    return F.when(bad, "").otherwise(F.substring(s, F.least(start, room).cast("int"), size))


def normalize(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", "")


def replace(s: Column, old: Column, new: Column) -> Column:
    """All literal occurrences; an empty ``old`` stands around every character."""
    around = F.concat(new, F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.concat(c, new)), ""))
    return F.when(F.length(old) == 0, around).otherwise(F.replace(s, old, new))


def translate(s: Column, source: Column, target: Column) -> Column:
    """The first occurrence of a character in ``source`` counts; those without a partner go."""
    def one(c: Column) -> Column:
        at = F.position(c, source)
        return F.when(at == 0, c).when(at <= F.length(target), F.substring(target, at, F.lit(1))).otherwise("")

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")

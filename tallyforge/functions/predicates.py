"""Predicates over notes as Columns; none needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def filled(c: Column) -> Column:
    """Not null and not empty; false (never null) otherwise."""
    return F.coalesce(c != "", F.lit(False))


def blank(c: Column) -> Column:
    """Null or white space alone."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def one_of(c: Column, values) -> Column:
    """Member of a closed set; null is none."""
    return F.coalesce(c.isin(*values), F.lit(False))


def flag(flags: Column, name: str) -> Column:
    """Text of a key of a JSON object, null where there is none."""
    return F.get_json_object(flags, f"$.{name}")


def synthetic(flags: Column) -> Column:
    """Flagged as having made-up metrics (JSON true and the text "true" alike)."""
    return flag(flags, "synthetic").eqNullSafe("true")


def hit(tier: Column) -> Column:
    return one_of(tier, V.HITS)


def real_hit(tier: Column, flags: Column) -> Column:
    """A hit whose metrics are not synthetic."""
    return hit(tier) & ~synthetic(flags)


def verified_hit(tier: Column, source: Column, flags: Column) -> Column:
    """A real hit that the source's status column declares."""
    return real_hit(tier, flags) & source.eqNullSafe(V.BY_STATUS)


def has(tags: Column, tag: str) -> Column:
    """Array membership where null elements and null arrays are no members."""
    return F.coalesce(F.array_contains(F.array_compact(tags), tag), F.lit(False))


def has_any(tags: Column, wanted) -> Column:
    """Array overlap under the same rule."""
    return F.coalesce(F.arrays_overlap(F.array_compact(tags), F.array(*(F.lit(x) for x in wanted))), F.lit(False))


def matches(text: Column, pattern: str, like: bool = False) -> Column:
    """Whether a text has a regular expression in it, or is LIKE a pattern; null stays null."""
    return text.like(pattern) if like else text.rlike(pattern)

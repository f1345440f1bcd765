"""Predicates and projections over a profile array.

A profile is ``array<struct<canonical, category, confidence, sources, job_mention_count,
job_mention_frequency>>``.  Higher-order functions test it in the row, so a search needs neither
an explode nor a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def has_tech(profile: Column, canonical: str, min_confidence: float | None = None) -> Column:
    def hit(t: Column) -> Column:
        same = t["canonical"] == canonical
        return same if min_confidence is None else same & (t["confidence"] >= min_confidence)

    return F.exists(profile, hit)


def uses_all(profile: Column, names: Sequence[str], min_confidence: float) -> Column:
    return reduce(Column.__and__, (has_tech(profile, n, min_confidence) for n in names))


def uses_any(profile: Column, names: Sequence[str], min_confidence: float) -> Column:
    wanted = list(names)
    return F.exists(
        profile, lambda t: t["canonical"].isin(wanted) & (t["confidence"] >= min_confidence)
    )


def uses_none(profile: Column, names: Sequence[str]) -> Column:
    """Exclusion looks at presence only; confidence plays no part."""
    unwanted = list(names)
    return ~F.exists(profile, lambda t: t["canonical"].isin(unwanted))


def has_category(profile: Column, category: str, min_confidence: float) -> Column:
    return F.exists(
        profile, lambda t: (t["category"] == category) & (t["confidence"] >= min_confidence)
    )


def first_entry_above(profile: Column, canonical: str, min_confidence: float) -> Column:
    """Containment of a technology together with a test on the first entry's confidence."""
    return has_tech(profile, canonical) & (F.get(profile, F.lit(0))["confidence"] > min_confidence)


def matched(profile: Column, targets: Sequence[str], min_confidence: float) -> Column:
    """Entries among the targets at or above the confidence, as (canonical, category, confidence)."""
    wanted = list(dict.fromkeys(targets))
    kept = F.filter(
        profile, lambda t: t["canonical"].isin(wanted) & (t["confidence"] >= min_confidence)
    )
    return F.transform(
        kept,
        lambda t: F.struct(
            t["canonical"].alias("canonical"),
            t["category"].alias("category"),
            t["confidence"].alias("confidence"),
        ),
    )


def at_least(profile: Column, min_confidence: float) -> Column:
    return F.filter(profile, lambda t: t["confidence"] >= min_confidence)


def names_of(profile: Column) -> Column:
    return F.transform(profile, lambda t: t["canonical"])


def names_by_category(profile: Column) -> Column:
    """``map<category, array<canonical>>``, categories in order of first appearance."""
    categories = F.array_distinct(F.transform(profile, lambda t: t["category"]))
    return F.map_from_arrays(
        categories,
        F.transform(
            categories,
            lambda c: names_of(F.filter(profile, lambda t: t["category"] == c)),
        ),
    )


def entries_by_category(profile: Column) -> Column:
    """``map<category, array<entry>>``, entries in profile order."""
    categories = F.array_distinct(F.transform(profile, lambda t: t["category"]))
    return F.map_from_arrays(
        categories,
        F.transform(categories, lambda c: F.filter(profile, lambda t: t["category"] == c)),
    )

"""Differences between two versions of the profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE = ("domain", "source")


def compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Old and new confidence side by side, one row per (domain, source, technology).

    Both inputs are ``profile_tech`` rows.  Only profiles present in ``current`` are compared, so
    an empty new profile yields nothing.  The two versions are stacked and shuffled once on
    (domain, source); the window and the aggregation share that partitioning, and a profile has at
    most two rows per technology.
    """
    cols = [*PROFILE, "canonical", "category", "confidence"]
    stacked = (
        previous.select(*cols, F.lit(False).alias("is_new"))
        .unionByName(current.select(*cols, F.lit(True).alias("is_new")))
        .withColumn("_refreshed", F.max("is_new").over(Window.partitionBy(*PROFILE)))
        .filter("_refreshed")
    )
    old, new = ~F.col("is_new"), F.col("is_new")
    return stacked.groupBy(*PROFILE, "canonical").agg(
        F.max(F.when(old, F.col("confidence"))).alias("old_confidence"),
        F.max(F.when(new, F.col("confidence"))).alias("new_confidence"),
        F.max(F.when(old, F.col("category"))).alias("old_category"),
        F.max(F.when(new, F.col("category"))).alias("new_category"),
    )


def _events(compared: DataFrame, detected_at: Column, confidence_changes: bool) -> DataFrame:
    old, new = F.col("old_confidence"), F.col("new_confidence")
    kind = F.when(old.isNull(), "added").when(new.isNull(), "removed")
    if confidence_changes:
        kind = kind.when(old != new, "confidence_change")
    return compared.select(
        *PROFILE,
        kind.alias("event_type"),
        "canonical",
        F.coalesce("new_category", "old_category").alias("category"),
        "old_confidence",
        "new_confidence",
        detected_at.cast("timestamp").alias("detected_at"),
    ).filter(F.col("event_type").isNotNull())


def change_events(
    previous: DataFrame, current: DataFrame, detected_at: Column, confidence_changes: bool = False
) -> DataFrame:
    """``added`` and ``removed`` events, and on request ``confidence_change``.

    A first-ever profile reports everything as added.
    """
    return _events(compare(previous, current), detected_at, confidence_changes)


def confidence_changes(previous: DataFrame, current: DataFrame, detected_at: Column) -> DataFrame:
    """Technologies in both versions whose confidence differs."""
    both = compare(previous, current).filter("old_confidence is not null and new_confidence is not null")
    return _events(both, detected_at, True)


def replay(previous: DataFrame, events: DataFrame) -> DataFrame:
    """The (domain, source, canonical) set after events are applied; the inverse of a diff."""
    cols = [*PROFILE, "canonical"]
    gone = events.filter("event_type = 'removed'").select(*cols)
    come = events.filter("event_type = 'added'").select(*cols)
    return previous.select(*cols).join(gone, cols, "left_anti").unionByName(come)

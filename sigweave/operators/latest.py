"""Newest rows per key.

All use ``row_number() <= n``: Spark applies the limit per key inside each map task as well, so a
key that holds a large share of the rows sends at most ``n`` rows per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ADOPTERS_LIMIT = 100


def newest(df: DataFrame, key: list[str], *order, n: int | None = 1, rank: str = "_rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def latest_profile(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each domain over all sources; ties fall to the first source name."""
    return newest(snapshots, ["domain"], F.desc("scraped_at"), "source").drop("_rank")


def latest_by_source(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each (domain, source): the current profiles."""
    return newest(snapshots, ["domain", "source"], F.desc("scraped_at")).drop("_rank")


def change_history(events: DataFrame, n: int | None = None) -> DataFrame:
    """The change events of each domain, or the newest ``n``, with their rank."""
    return newest(
        events, ["domain"], F.desc("detected_at"), "canonical", "event_type", "source",
        n=n, rank="rank",
    )


def recent_adopters(events: DataFrame, canonical: str, n: int = ADOPTERS_LIMIT) -> DataFrame:
    """The newest ``n`` domains that added one technology (a top-n, never a full sort)."""
    return (
        events.filter((F.col("canonical") == canonical) & (F.col("event_type") == "added"))
        .orderBy(F.desc("detected_at"), "domain", "source")
        .limit(n)
        .select("domain", "source", "detected_at")
    )

"""Upserts as whole new versions: plain Parquet has no MERGE, so each returns the table to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert_company(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Insert companies, or update name and ``updated_at``; ``created_at`` is kept.

    ``batch`` has domain, name and ord; the last row of a domain wins.
    """
    fresh = batch.groupBy("domain").agg(F.max_by("name", "ord").alias("new_name"))
    both = stored.join(fresh, "domain", "full_outer")
    seen = F.col("new_name").isNotNull()
    return both.select(
        "domain",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce(F.col("created_at"), F.when(seen, now)).alias("created_at"),
        F.when(seen, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_profile(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Current profiles after a batch of snapshots: the newest per (domain, source) replaces all
    columns but ``created_at``.

    Both sides are stacked, and one shuffle on (domain, source) serves both windows.  ``stored``
    has at most one row per key.
    """
    key = Window.partitionBy("domain", "source")
    columns = [
        "domain", "source", "job_count", "tech_count", "tech_profile", "scraped_at",
    ]
    stacked = stored.select(
        *columns, "created_at", "updated_at", F.lit(0).alias("_new")
    ).unionByName(
        batch.select(
            *columns, now.alias("created_at"), now.alias("updated_at"), F.lit(1).alias("_new")
        )
    )
    return (
        stacked.withColumn("created_at", F.min("created_at").over(key))
        .withColumn(
            "_rank",
            F.row_number().over(key.orderBy(F.desc("_new"), F.desc("scraped_at"))),
        )
        .filter("_rank = 1")
        .select(*columns, "created_at", "updated_at")
    )

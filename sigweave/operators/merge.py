"""Merging the profiles of one domain across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sigweave.operators.latest import latest_by_source
from sigweave.operators.profile import boosted


def merged_rows(snapshots: DataFrame) -> DataFrame:
    """One row per domain and technology, and one without a technology where a profile is empty.

    ``profiles`` lists the (age, source) pairs behind the row, age 1 being the newest profile of
    the domain.  A domain has one current profile per source, so every list here is as short as
    the list of sources, and all steps after the newest profiles are chosen share one shuffle.
    """
    per_domain = Window.partitionBy("domain")
    aged = latest_by_source(snapshots).select(
        "domain", "source", "tech_profile",
        F.max("scraped_at").over(per_domain).alias("last_scraped"),
        F.row_number().over(per_domain.orderBy(F.desc("scraped_at"), "source")).alias("age"),
    )
    rows = aged.select(
        "domain", "source", "last_scraped", "age",
        F.posexplode_outer("tech_profile").alias("tech_ord", "t"),
    ).select("domain", "source", "last_scraped", "age", "tech_ord", "t.*")
    merged = rows.groupBy("domain", "canonical").agg(
        F.array_sort(
            F.collect_list(
                F.struct("age", "source", "tech_ord", "confidence", "category", "sources")
            )
        ).alias("seen"),
        F.max("job_mention_count").alias("job_mention_count"),
        F.max("job_mention_frequency").alias("job_mention_frequency"),
        F.max("last_scraped").alias("last_scraped"),
    )
    newest = F.get("seen", F.lit(0))
    return merged.select(
        "domain",
        "canonical",
        newest["category"].alias("category"),
        boosted(newest["confidence"], F.size("seen") - 1).alias("confidence"),
        F.array_distinct(F.flatten(F.transform("seen", lambda r: r["sources"]))).alias("sources"),
        "job_mention_count",
        "job_mention_frequency",
        "last_scraped",
        newest["age"].alias("first_age"),
        newest["tech_ord"].alias("first_ord"),
        F.transform("seen", lambda r: F.struct(r["age"], r["source"])).alias("profiles"),
    )


def merge_profiles(snapshots: DataFrame) -> DataFrame:
    """One row per domain and technology over the current profiles of the domain.

    The newest profile that has the technology gives the base confidence; each further *profile*
    (not each further distinct source) adds a boost.  Mention figures are maxima, sources a union
    in order, ``last_scraped`` the newest scrape of the domain.
    """
    return merged_rows(snapshots).filter(F.col("canonical").isNotNull()).drop("profiles")

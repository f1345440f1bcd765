"""The report of a run: every scrape with its profile, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigweave.functions.profiles import entries_by_category
from sigweave.functions.text import round2

TOP_TECH = 15


def run_report(snapshots: DataFrame, companies: DataFrame, top_n: int = TOP_TECH) -> DataFrame:
    """One row per scrape: company, counts, profile, by category, and the top technologies.

    ``snapshots`` holds a row for scrapes without a technology, too (``tech_profile`` with
    ``keep_empty``); they count in the totals like the others.

    A domain without a company goes by the domain itself.
    """
    # A stored profile is in confidence order already, so its head is the top.
    top = F.transform(
        F.slice("tech_profile", 1, top_n),
        lambda t: F.struct(
            t["canonical"].alias("name"),
            t["category"].alias("category"),
            round2(t["confidence"]).alias("confidence"),
            t["job_mention_count"].alias("job_mentions"),
        ),
    )
    named = snapshots.join(companies.select("domain", "name"), "domain", "left")
    return named.select(
        F.coalesce("name", "domain").alias("company_name"),
        "domain", "source", "scraped_at", "job_count", "tech_count", "tech_profile",
        entries_by_category(F.col("tech_profile")).alias("by_category"),
        top.alias("top_tech"),
    )


def run_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count("*").alias("total_companies"), F.sum("job_count").alias("total_jobs")
    )


def write_report(
    snapshots: DataFrame, companies: DataFrame, path: str, run_at: Column, completed_at: Column
) -> None:
    """Results as JSON lines under ``results``, the header with totals under ``header``."""
    run_report(snapshots, companies).write.mode("overwrite").json(f"{path}/results")
    run_totals(snapshots).select(
        run_at.cast("timestamp").alias("run_at"),
        completed_at.cast("timestamp").alias("completed_at"),
        "total_companies", "total_jobs",
    ).write.mode("overwrite").json(f"{path}/header")

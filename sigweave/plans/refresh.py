"""End-to-end refresh: postings and captures to profiles, upserts and change events."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigweave.operators.changes import change_events
from sigweave.operators.header_signals import header_profile
from sigweave.operators.profile import snapshot, tech_profile, unnest
from sigweave.operators.upsert import upsert_company, upsert_profile
from sigweave.sources.taxonomy import Alias


class Refresh(NamedTuple):
    companies: DataFrame
    profiles: DataFrame
    events: DataFrame


def fresh_profiles(
    postings: DataFrame, captures: DataFrame | None, aliases: Sequence[Alias]
) -> DataFrame:
    """``profile_tech`` rows of a batch; scrapes without any technology are left out."""
    fresh = tech_profile(postings, aliases)
    if captures is not None:
        fresh = fresh.unionByName(header_profile(captures))
    return fresh


def scraped_names(
    domains: DataFrame, postings: DataFrame | None, captures: DataFrame | None, registry: DataFrame
) -> DataFrame:
    """domain, name and ord for upserting the companies of ``domains``, listed in the registry or not.

    The name is the one of the newest scrape that has one (``company_name``, where the inputs have
    it), else the registry's last, else the domain.
    """
    scraped = [df for df in (postings, captures) if df is not None and "company_name" in df.columns]
    listed = registry.groupBy("domain").agg(F.max_by("company_name", "ord").alias("listed"))
    named = domains.join(listed, "domain", "left").withColumn("scraped", F.lit(None).cast("string"))
    if scraped:
        seen = [df.select("domain", "company_name", "scraped_at").filter("company_name is not null") for df in scraped]
        rows = seen[0] if len(seen) == 1 else seen[0].unionByName(seen[1])
        # Ties fall to the last name, so the result does not hang on the order of rows.
        newest = rows.groupBy("domain").agg(F.max(F.struct("scraped_at", "company_name"))["company_name"].alias("scraped"))
        named = named.drop("scraped").join(newest, "domain", "left")
    return named.select("domain", F.coalesce("scraped", "listed", "domain").alias("name"), F.lit(0).alias("ord"))


def refresh(
    fresh: DataFrame,
    registry: DataFrame,
    companies: DataFrame,
    profiles: DataFrame,
    now: Column,
    confidence_changes: bool = False,
    postings: DataFrame | None = None,
    captures: DataFrame | None = None,
) -> Refresh:
    """New versions of the company and profile tables, and the change events of a batch.

    ``fresh`` are ``profile_tech`` rows with one scrape per (domain, source); ``registry`` has
    domain, company_name and ord; ``companies`` and ``profiles`` are the stored tables.  Company names
    come from ``postings`` and ``captures``, where given; the registry names the rest.
    """
    touched = fresh.select("domain").distinct()
    scrapes = [df for df in (postings, captures) if df is not None]
    names = scraped_names(touched, *(scrapes + [None, None])[:2], registry)
    return Refresh(
        upsert_company(companies, names, now),
        upsert_profile(profiles, snapshot(fresh), now),
        change_events(unnest(profiles), fresh, now, confidence_changes),
    )


def run_refresh(
    spark: SparkSession,
    postings: DataFrame,
    captures: DataFrame | None,
    registry: DataFrame,
    companies: DataFrame,
    profiles: DataFrame,
    aliases: Sequence[Alias],
    now: Column,
    out: str,
    run_id: str,
) -> None:
    """Run a refresh and write its tables below ``out``, in folders named after the run.

    The batch profile is written first and read back, so the texts are searched once and every
    later step restarts from a table.  Repeating a run id replaces what the run wrote.
    """
    fresh_path = f"{out}/profile_tech/run={run_id}"
    fresh_profiles(postings, captures, aliases).write.mode("overwrite").parquet(fresh_path)
    fresh = spark.read.parquet(fresh_path)
    result = refresh(fresh, registry, companies, profiles, now, postings=postings, captures=captures)
    for name, table in result._asdict().items():
        table.write.mode("overwrite").parquet(f"{out}/{name}/run={run_id}")

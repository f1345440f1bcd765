"""Company list and search by technology stack."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigweave import params
from sigweave.functions import profiles as p
from sigweave.operators.latest import latest_profile
from sigweave.plans.paging import Page, page_rows, pagination


def company_list(
    companies: DataFrame,
    snapshots: DataFrame,
    q: str | None = None,
    sort: str = "updated_at",
    order: str = "desc",
    page: int = 1,
    per_page: int = params.PER_PAGE,
) -> Page:
    """Companies with their number of profiles and last scrape.

    The page is cut before the join, so profiles are looked up only for the companies shown.
    ``snapshots`` holds the current profiles, one row per (domain, source).
    """
    page, per_page = params.paging(page, per_page)
    column, descending = params.sorting(sort, order)
    text = params.search_text(q)
    chosen = companies
    if text:
        # A backslash takes the next character as it is; before an ordinary one it says nothing.
        pattern = re.sub(r"(?s)\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{text.lower()}%")
        chosen = companies.filter(
            F.lower("domain").like(pattern) | F.lower("name").like(pattern)
        )
    # Descending order puts missing values first, ascending order last.
    key = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    total_order = [key] if column == "domain" else [key, F.col("domain")]
    shown = page_rows(
        chosen.select("domain", "name", "created_at", "updated_at"), total_order, page, per_page
    )
    stats = (
        snapshots.join(F.broadcast(shown.select("domain")), "domain", "left_semi")
        .groupBy("domain")
        .agg(F.count("*").alias("source_count"), F.max("scraped_at").alias("last_scraped"))
    )
    data = (
        shown.join(stats, "domain", "left")
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
        .orderBy(*total_order)
    )
    return Page(data, pagination(chosen.agg(F.count("*").alias("total")), page, per_page))


def stack_condition(
    profile: Column,
    uses: Sequence[str] = (),
    uses_any: Sequence[str] = (),
    excludes: Sequence[str] = (),
    category: str | None = None,
    min_confidence: float = params.MIN_CONFIDENCE,
) -> Column:
    """All of ``uses``, any of ``uses_any``, none of ``excludes``, and the category, on a profile."""
    tests = []
    if uses:
        tests.append(p.uses_all(profile, uses, min_confidence))
    if uses_any:
        tests.append(p.uses_any(profile, uses_any, min_confidence))
    if excludes:
        tests.append(p.uses_none(profile, excludes))
    if category:
        tests.append(p.has_category(profile, category, min_confidence))
    condition = F.lit(True)
    for test in tests:
        condition = condition & test
    return condition


def matching_profiles(snapshots: DataFrame, **wanted) -> DataFrame:
    """Newest profiles of domains that satisfy a stack condition.

    The condition applies after the newest profile is chosen: an older one may not stand in.
    """
    return latest_profile(snapshots).filter(stack_condition(F.col("tech_profile"), **wanted))


def search_stack(
    snapshots: DataFrame,
    companies: DataFrame,
    uses: Sequence[str] | None = None,
    uses_any: Sequence[str] | None = None,
    excludes: Sequence[str] | None = None,
    category: str | None = None,
    min_confidence: float = params.MIN_CONFIDENCE,
    page: int = 1,
    per_page: int = params.PER_PAGE,
) -> Page:
    """Which companies use these, any of those, and none of the others?  Newest scrape first."""
    page, per_page = params.paging(page, per_page)
    floor = params.confidence(min_confidence)
    every = params.targets("uses", uses)
    some = params.targets("uses_any", uses_any)
    none = params.targets("excludes", excludes, least=0)
    if not every and not some:
        raise ValueError("give at least one of uses, uses_any")
    found = matching_profiles(
        snapshots, uses=every, uses_any=some, excludes=none, category=category,
        min_confidence=floor,
    )
    named = found.join(companies.select("domain", "name"), "domain")
    shown = page_rows(named, [F.desc("scraped_at"), F.col("domain")], page, per_page)
    data = shown.select(
        "domain", "name",
        F.col("scraped_at").alias("last_scraped"),
        "job_count",
        p.matched(F.col("tech_profile"), [*every, *some], floor).alias("matched_technologies"),
    )
    return Page(data, pagination(found.agg(F.count("*").alias("total")), page, per_page))

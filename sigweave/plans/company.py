"""Company detail for a set of domains at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigweave import params
from sigweave.functions.profiles import entries_by_category
from sigweave.operators.latest import change_history
from sigweave.operators.merge import merged_rows


def profiles_by_source(snapshots: DataFrame, sources: str | None) -> DataFrame:
    """Profiles of the named sources; a list without a known source filters nothing."""
    wanted = params.sources(sources)
    return snapshots.filter(F.col("source").isin(wanted)) if wanted else snapshots


def company_detail(
    companies: DataFrame,
    snapshots: DataFrame,
    sources: str | None = None,
    category: str | None = None,
    min_confidence: float | None = None,
    events: DataFrame | None = None,
    history: int | None = None,
) -> DataFrame:
    """One row per company with a profile: merged technologies, by category, sources, history.

    Technologies come by confidence, then in the order the newest profile lists them.  With
    ``events`` the newest change events come along, at most 100 a company.
    """
    kept = F.col("canonical").isNotNull()
    if category:
        kept = kept & (F.col("category") == category)
    if min_confidence is not None:
        kept = kept & (F.col("confidence") >= params.confidence(min_confidence))
    entry = F.struct(
        (-F.col("confidence")).alias("k1"), F.col("first_age").alias("k2"),
        F.col("first_ord").alias("k3"), "canonical", "category", "confidence", "sources",
        "job_mention_count", "job_mention_frequency",
    )
    nested = merged_rows(profiles_by_source(snapshots, sources)).groupBy("domain").agg(
        F.max("last_scraped").alias("last_scraped"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("profiles")))).alias("profiles"),
        F.array_sort(F.collect_list(F.when(kept, entry))).alias("entries"),
    )
    detail = (
        companies.select("domain", F.col("name").alias("company"))
        .join(nested, "domain")
        .select(
            "domain", "company", "last_scraped",
            F.transform("profiles", lambda x: x["source"]).alias("sources_available"),
            F.transform("entries", lambda e: e.dropFields("k1", "k2", "k3")).alias("technologies"),
        )
        .withColumn("tech_count", F.size("technologies"))
        .withColumn("by_category", entries_by_category(F.col("technologies")))
    )
    if events is None:
        return detail
    past = change_history(events, history).groupBy("domain").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank", "event_type", "canonical", "category",
                    "old_confidence", "new_confidence", "detected_at",
                )
            )
        ).alias("h")
    )
    return detail.join(past, "domain", "left").withColumn(
        "history",
        F.transform(F.coalesce("h", F.array()), lambda x: x.dropFields("rank")),
    ).drop("h")

"""From mentions and signals to technology profiles.

``profile_tech`` is the working form, one row per scrape and technology; the nested ``snapshot``
form exists only where a whole profile is stored, searched or exported.  A scrape is identified
by (domain, source, scraped_at).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigweave.functions.text import round2, round4
from sigweave.operators.mentions import mentions, with_mentions
from sigweave.sources.taxonomy import Alias, load_aliases

SCRAPE = ("domain", "source", "scraped_at")

# Base confidence by kind of signal, that of any other kind, the boost for each
# further source, and the ceiling.
SIGNAL_WEIGHTS = {
    "html_headers": 0.95,
    "job_listing": 0.70,
    "github_org": 0.85,
    "g2_profile": 0.60,
    "linkedin": 0.55,
}
OTHER_WEIGHT = 0.5
SOURCE_BOOST = 0.05
MAX_CONFIDENCE = 0.99
POSTING_SIGNAL = "job_listing"


def boosted(base: Column, further: Column) -> Column:
    """Confidence after ``further`` confirmations."""
    return round4(F.least(F.lit(MAX_CONFIDENCE), base + SOURCE_BOOST * further))


def weight_of(source: Column, weights: Mapping[str, float] = SIGNAL_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(OTHER_WEIGHT))


def mention_rollup(mentions: DataFrame) -> DataFrame:
    """Postings per technology of a scrape, with the raw mention of the first posting.

    ``rank`` orders a scrape's technologies by postings, then by first appearance.  The mentions of
    any taxonomy will do; whatever the raw mention was, it is carried along as it is.
    """
    counted = (
        mentions.groupBy(*SCRAPE, "canonical", "category")
        .agg(
            F.count("*").alias("posting_count"),
            F.min_by("raw_mention", "pos").alias("raw_mention"),
            F.min("pos").alias("first_pos"),
            F.min_by("alias_ord", "pos").alias("first_alias"),
        )
    )
    order = Window.partitionBy(*SCRAPE).orderBy(F.desc("posting_count"), "first_pos", "first_alias")
    return counted.select(
        *SCRAPE, "canonical", "category", "posting_count", "raw_mention", "first_pos", "first_alias",
        F.row_number().over(order).alias("rank"),
    )


def tech_profile(
    postings: DataFrame, aliases: DataFrame | Sequence[Alias], keep_empty: bool = False, strategy: str = "scan"
) -> DataFrame:
    """The profile of each scrape's postings, one row per technology.

    With ``keep_empty`` each scrape keeps a row without a technology, so that ``snapshot`` has one for
    scrapes that found none, too; for a report of a run, not for storing.  ``aliases`` may be a table,
    and ``strategy`` is that of ``mentions``.

    One pass over the texts: every posting also emits a marker row without a technology, so the
    number of postings falls out of the same map-side aggregation as the mention counts.  After
    it a scrape has at most one row per technology, which bounds the window.
    """
    columns = [*SCRAPE, "pos", "canonical", "category", "alias_ord"]
    if strategy == "join":
        found = mentions(postings, aliases, "join", [*SCRAPE, "posting_id", "pos"]).select(*columns)
        rows = found.unionByName(postings.select(*SCRAPE, "pos"), allowMissingColumns=True)
    else:
        marker = "array<struct<canonical:string,category:string,raw_mention:string,alias_ord:int>>"
        known = load_aliases(aliases) if isinstance(aliases, DataFrame) else aliases
        one = F.array(F.lit(None)).cast(marker)
        rows = with_mentions(postings, known, [*SCRAPE, "pos"]).select(
            *SCRAPE, "pos", F.explode_outer(F.concat(one, "mentions")).alias("m")
        ).select(*SCRAPE, "pos", "m.canonical", "m.category", "m.alias_ord")
    counted = rows.groupBy(*SCRAPE, "canonical", "category").agg(
        F.count("*").alias("n"),
        F.min("pos").alias("first_pos"),
        F.min_by("alias_ord", "pos").alias("first_alias"),
    )
    scrape = Window.partitionBy(*SCRAPE)
    return (
        counted.withColumn(
            "job_count", F.max(F.when(F.col("canonical").isNull(), F.col("n"))).over(scrape)
        )
        .filter(F.lit(keep_empty) | F.col("canonical").isNotNull())
        .select(
            *SCRAPE, "canonical", "category",
            F.lit(SIGNAL_WEIGHTS[POSTING_SIGNAL]).alias("confidence"),
            F.array(F.lit(POSTING_SIGNAL)).alias("sources"),
            F.col("n").cast("int").alias("job_mention_count"),
            round2(F.col("n") / F.col("job_count")).alias("job_mention_frequency"),
            F.col("job_count").cast("int").alias("job_count"),
            F.row_number()
            .over(scrape.orderBy(F.col("canonical").isNull(), "first_pos", "first_alias"))
            .alias("tech_ord"),
        )
    )


def score_signals(
    signals: DataFrame, weights: Mapping[str, float] = SIGNAL_WEIGHTS
) -> DataFrame:
    """Confidence of each technology of a domain over signal groups.

    ``signals`` has domain, group_pos (arrival order of the group), source, canonical, category,
    raw_mention and optionally tech_pos (order inside the group).  The first group's weight is the
    base; every further distinct source adds a boost.  The first step leaves one row per source,
    however many groups a source has, so the ordered lists of the second stay short.  ``rank`` orders a
    domain's technologies by confidence, then by arrival.
    """
    if "tech_pos" not in signals.columns:
        signals = signals.withColumn("tech_pos", F.lit(0))
    arrival = F.struct("group_pos", "tech_pos")
    per_source = signals.groupBy("domain", "canonical", "source").agg(
        F.min(arrival).alias("arrived"),
        F.min_by(F.struct("category", "raw_mention"), arrival).alias("first"),
    )
    in_order = F.array_sort(
        F.collect_list(
            F.struct("arrived", "source", "first.category", "first.raw_mention")
        )
    )
    scored = per_source.groupBy("domain", "canonical").agg(in_order.alias("s"))
    first = F.get("s", F.lit(0))
    order = Window.partitionBy("domain").orderBy(F.desc("confidence"), "arrived", "canonical")
    return scored.select(
        "domain",
        "canonical",
        first["category"].alias("category"),
        boosted(weight_of(first["source"], weights), F.size("s") - 1).alias("confidence"),
        F.transform("s", lambda x: x["source"]).alias("sources"),
        F.transform("s", lambda x: x["raw_mention"]).alias("raw_mentions"),
        first["arrived"].alias("arrived"),
    ).withColumn("rank", F.row_number().over(order))


def snapshot(profile_tech: DataFrame) -> DataFrame:
    """The stored form: one row per scrape with the profile as an ordered array."""
    entry = F.struct(
        "tech_ord", "canonical", "category", "confidence", "sources",
        "job_mention_count", "job_mention_frequency",
    )
    nested = profile_tech.groupBy(*SCRAPE).agg(
        F.max("job_count").alias("job_count"),
        F.count("canonical").cast("int").alias("tech_count"),
        F.array_sort(F.collect_list(F.when(F.col("canonical").isNotNull(), entry))).alias("entries"),
    )
    return nested.select(
        *SCRAPE, "job_count", "tech_count",
        F.transform("entries", lambda e: e.dropFields("tech_ord")).alias("tech_profile"),
    )


def unnest(snapshots: DataFrame, *extra: str) -> DataFrame:
    """The working form of stored snapshots, with further columns carried along."""
    exploded = snapshots.select(
        *SCRAPE, "job_count", *extra, F.posexplode_outer("tech_profile").alias("_p", "_e")
    ).filter(F.col("_p").isNotNull())
    return exploded.select(
        *SCRAPE, "_e.*", "job_count", (F.col("_p") + 1).alias("tech_ord"), *extra
    )


def by_category(profile_tech: DataFrame, keys: Sequence[str] = SCRAPE) -> DataFrame:
    """Technologies of each profile by category, in profile order.

    One row per key and category; the list is bounded by the taxonomy.
    """
    listed = profile_tech.groupBy(*keys, "category").agg(
        F.array_sort(F.collect_list(F.struct("tech_ord", "canonical", "confidence"))).alias("t")
    )
    return listed.select(
        *keys, "category",
        F.transform("t", lambda x: x["canonical"]).alias("technologies"),
        F.transform("t", lambda x: x["confidence"]).alias("confidences"),
    )


def top_tech(profile_tech: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` technologies of each profile by confidence, then by first appearance."""
    rank = F.row_number().over(
        Window.partitionBy(*SCRAPE).orderBy(F.desc("confidence"), "tech_ord")
    )
    return (
        profile_tech.withColumn("rank", rank)
        .filter(F.col("rank") <= n)
        .select(
            *SCRAPE, "rank", "canonical", "category",
            round2(F.col("confidence")).alias("confidence"), "job_mention_count",
        )
    )


def profile_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count("*").alias("profiles"), F.sum("tech_count").alias("tech_signals")
    )

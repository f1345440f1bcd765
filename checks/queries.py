"""The registered queries: every operator over the driver tables.

Results are flattened for comparison: times and lists become text, long texts their digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import fixtures as fx
from sigweave import params
from sigweave.functions import profiles as pf
from sigweave.functions.text import key_hash, strip_html, valid_domain
from sigweave.operators import (
    billing, changes, header_signals as hs, latest, merge, profile, runs, upsert, usage, webhooks,
)
from sigweave.operators.mentions import mentions
from sigweave.plans import company, current, export, refresh, report, search
from sigweave.session import shared_dir
from sigweave.sources import boards, html, registry
from sigweave.sources.taxonomy import Alias, alias_map, taxonomy_frame
from sigweave.sources.store import Store
from sigweave.streaming import changes as change_streams, outbox as outbox_streams, rates as rate_streams

Query = Callable[[SparkSession, str], DataFrame]

# Words that occur in the documents as they are, for untouched multilingual text.
WORDS = [
    Alias("English", "en", a, i) for i, a in enumerate(["the", "and", "of"])
] + [
    Alias("Romance", "fr-es", a, 3 + i) for i, a in enumerate(["que", "la", "le", "el", "los", "de la"])
] + [
    Alias("German", "de", a, 9 + i) for i, a in enumerate(["der", "die", "und", "und der"])
]

USES, USES_ANY, EXCLUDES = ["React"], ["Python", "Go", "AWS"], ["Clojure", "Helm"]


def ts(col: str | Column) -> Column:
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd HH:mm:ss")


def joined(col: str | Column) -> Column:
    return F.array_join(col, "|")


def entries_text(col: str | Column) -> Column:
    """A list of profile entries as ``canonical:confidence`` in order."""
    return F.array_join(
        F.transform(
            col,
            lambda t: F.concat_ws(":", t["canonical"], F.format_number(t["confidence"], 2)),
        ),
        "|",
    )


def categories_text(col: str | Column, name=lambda t: t["canonical"]) -> Column:
    """``map<category, list>`` as text, categories sorted, lists in order."""
    return F.array_join(
        F.array_sort(
            F.transform(
                F.map_entries(col),
                lambda e: F.concat(
                    e["key"], F.lit("="), F.array_join(F.transform(e["value"], name), ",")
                ),
            )
        ),
        ";",
    )


# -- shared steps ---------------------------------------------------------------------------

def all_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.tech_profile(fx.postings(spark, sf), fx.ALIASES)


def all_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return profile.snapshot(all_profiles(spark, sf))


def is_old() -> Column:
    return F.col("scraped_at") < F.lit(fx.SPLIT).cast("timestamp")


def versions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(is_old()), df.filter(~is_old())


def events(spark: SparkSession, sf: str) -> DataFrame:
    old, new = versions(all_profiles(spark, sf))
    return changes.change_events(old, new, fx.now())


# -- sources --------------------------------------------------------------------------------

def _flat_postings(p: DataFrame) -> DataFrame:
    return p.select(
        "domain", "posting_id", "pos", "title", F.md5("description").alias("description_md5"),
        "location", "department", "team", "url", ts("posted_at").alias("posted_at"),
    )


def ingest_board_a(spark, sf):
    return _flat_postings(boards.postings_a(fx.payloads_a(spark, sf)))


def ingest_board_b(spark, sf):
    return _flat_postings(boards.postings_b(fx.payloads_b(spark, sf)))


def html_job_links(spark, sf):
    return html.job_links(fx.result_pages(spark, sf))


def html_job_detail(spark, sf):
    return html.job_details(fx.job_pages(spark, sf)).select(
        "page_id", "url", "title", "company", F.md5("description").alias("description_md5")
    )


def html_job_postings(spark, sf):
    links = html.job_links(fx.result_pages(spark, sf))
    details = html.job_details(fx.job_pages(spark, sf))
    return html.job_postings(links, details).select(
        "page_id", "pos", "posting_id", "title", "url", F.md5("description").alias("description_md5")
    )


def html_pagination(spark, sf):
    return html.pagination(fx.result_pages(spark, sf))


def search_addresses(spark, sf):
    c = fx.load(spark, sf, "customer")
    name = F.concat("c_name", F.lit(" (R&D) & Söhne*'s!~+"))
    return c.select(
        "c_custkey", html.search_address(name, F.col("c_mktsegment")).alias("url")
    )


def registry_filter(spark, sf):
    return registry.registry_filter(fx.registry(spark, sf), board="lever")


def discover_token_a(spark, sf):
    return html.discover_tokens(fx.career_pages(spark, sf), "greenhouse").select("page_id", "token")


def discover_token_b(spark, sf):
    return html.discover_tokens(fx.career_pages(spark, sf), "lever").select("page_id", "token")


def worklist(spark, sf):
    return registry.worklist(fx.registry(spark, sf))


def registry_dedupe(spark, sf):
    return registry.dedupe_by(fx.registry(spark, sf), "domain", "ord")


# -- text -----------------------------------------------------------------------------------

def _marked_pages(spark, sf):
    i = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("<SCRIPT type='x'>var a = '<b>';</SCRIPT> &nbsp;R&amp;D &amp;lt;b&gt; it&#39;s \n x"), i,
        F.lit("\n﻿ <p>end</p>　"),
    )
    pages = fx.texts(spark, sf, "pages", "page_id")
    return pages.select("page_id", F.concat("html", extra).alias("html"))


def _stripped(spark, sf, mode):
    text = _marked_pages(spark, sf).select("page_id", strip_html(F.col("html"), mode).alias("t"))
    return text.select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars")
    )


def strip_html_full(spark, sf):
    return _stripped(spark, sf, "full")


def strip_html_short(spark, sf):
    return _stripped(spark, sf, "short")


def _flat_mentions(m: DataFrame) -> DataFrame:
    return m.select("posting_id", "domain", "source", "canonical", "category", "raw_mention", "alias_ord")


def extract_mentions(spark, sf):
    return _flat_mentions(mentions(fx.postings(spark, sf), fx.ALIASES, "scan"))


def extract_mentions_anchor(spark, sf):
    return _flat_mentions(mentions(fx.postings(spark, sf), taxonomy_frame(spark), "join"))


def extract_words(spark, sf):
    docs = fx.texts(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("posting_id"), F.lit(None).cast("string").alias("title"),
        F.col("text").alias("description"),
    )
    return mentions(docs, WORDS, "scan", keep=("posting_id",))


def alias_map_(spark, sf):
    """Aliases as the documents write them, resolved to technologies."""
    written = fx.load(spark, sf, "documents").select(
        F.explode(F.array(fx.alias_at(F.col("doc_id") * 13), fx.alias_at(F.col("doc_id") * 31))).alias("alias")
    )
    counted = written.groupBy("alias").agg(F.count("*").alias("n"))
    return counted.join(alias_map(taxonomy_frame(spark)), "alias")


def valid_domain_(spark, sf):
    i = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    written = (
        F.when(i % 5 == 0, F.concat(F.lit("-"), host)).when(i % 5 == 1, F.upper(host))
        .when(i % 5 == 2, F.concat(host, F.lit("\n"))).when(i % 5 == 3, F.regexp_replace(host, r"\.", "_"))
        .otherwise(host)
    )
    named = fx.load(spark, sf, "pages").select("page_id", written.alias("d"))
    return named.filter(valid_domain(F.col("d"))).select("page_id", F.lower("d").alias("domain"))


# -- headers --------------------------------------------------------------------------------

def header_signals(spark, sf):
    return hs.header_signals(fx.captures(spark, sf)).select(
        "domain", "rule_ord", "canonical", "category", "confidence", "source"
    )


def meta_generator_signals(spark, sf):
    return hs.generator_signals(fx.captures(spark, sf)).select(
        "domain", "generator", "rule_ord", "canonical", "category", "confidence", "source"
    )


def header_profile(spark, sf):
    return hs.header_profile(fx.captures(spark, sf)).select(
        "domain", "canonical", "category", "confidence", joined("sources").alias("sources"), "tech_ord"
    )


# -- profiles -------------------------------------------------------------------------------

def mention_rollup(spark, sf):
    m = mentions(fx.postings(spark, sf), fx.ALIASES, "scan")
    return profile.mention_rollup(m).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "canonical", "category",
        "posting_count", "raw_mention", "rank",
    )


def tech_profile_large(spark, sf):
    """Profiles by a taxonomy of 50,000 aliases, most of them of technologies that nobody names."""
    known = spark.range(1, 50_001 - len(fx.ALIASES)).select(
        F.concat(F.lit("Tool "), "id").alias("canonical"), F.lit("made").alias("category"),
        F.concat(F.lit("tool"), "id").alias("alias"), (F.col("id") + 1000).cast("int").alias("alias_ord"),
    )
    return profile.tech_profile(
        fx.postings(spark, sf), taxonomy_frame(spark).unionByName(known), strategy="join"
    ).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "canonical", "category",
        "confidence", joined("sources").alias("sources"), "job_mention_count",
        "job_mention_frequency", "job_count", "tech_ord",
    )


def score_signals(spark, sf):
    return profile.score_signals(fx.signal_groups(spark, sf)).select(
        "domain", "canonical", "category", "confidence",
        joined("sources").alias("sources"), joined("raw_mentions").alias("raw_mentions"), "rank",
    )


def tech_profile(spark, sf):
    return all_profiles(spark, sf).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "canonical", "category",
        "confidence", joined("sources").alias("sources"), "job_mention_count",
        "job_mention_frequency", "job_count", "tech_ord",
    )


def by_category(spark, sf):
    return profile.by_category(all_profiles(spark, sf)).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "category",
        joined("technologies").alias("technologies"),
    )


def top_tech(spark, sf):
    return profile.top_tech(all_profiles(spark, sf)).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "rank", "canonical",
        "confidence", "job_mention_count",
    )


def profile_totals(spark, sf):
    return profile.profile_totals(all_snapshots(spark, sf))


def merge_profiles(spark, sf):
    return merge.merge_profiles(all_snapshots(spark, sf)).select(
        "domain", "canonical", "category", "confidence", joined("sources").alias("sources"),
        "job_mention_count", "job_mention_frequency", ts("last_scraped").alias("last_scraped"),
    )


def _flat_snapshots(s: DataFrame) -> DataFrame:
    return s.select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "job_count", "tech_count",
        joined(pf.names_of(F.col("tech_profile"))).alias("technologies"),
    )


def latest_profile(spark, sf):
    return _flat_snapshots(latest.latest_profile(all_snapshots(spark, sf)))


def latest_by_source(spark, sf):
    return _flat_snapshots(latest.latest_by_source(all_snapshots(spark, sf)))


def profiles_by_source(spark, sf):
    return _flat_snapshots(
        company.profiles_by_source(all_snapshots(spark, sf), " lever, nowhere ,indeed")
    )


# -- company queries ------------------------------------------------------------------------

def company_detail(spark, sf):
    detail = company.company_detail(
        fx.companies(spark, sf), all_snapshots(spark, sf), sources="greenhouse,lever,indeed",
        min_confidence=0.75, events=events(spark, sf),
    )
    return detail.select(
        "domain", "company", ts("last_scraped").alias("last_scraped"),
        joined("sources_available").alias("sources_available"), "tech_count",
        entries_text("technologies").alias("technologies"),
        categories_text("by_category").alias("by_category"),
        F.size("history").alias("history_size"),
        F.array_join(
            F.transform("history", lambda h: F.concat_ws(":", h["event_type"], h["canonical"])), "|"
        ).alias("history"),
    )


def company_detail_category(spark, sf):
    return company.company_detail(
        fx.companies(spark, sf), all_snapshots(spark, sf), category="language"
    ).select("domain", "tech_count", entries_text("technologies").alias("technologies"))


def _company_page(spark, sf):
    current = latest.latest_by_source(all_snapshots(spark, sf))
    return search.company_list(
        fx.companies(spark, sf), current, q="C_%0", sort="updated_at", page=2, per_page=40
    )


def company_list(spark, sf):
    return _company_page(spark, sf).data.select(
        "domain", "name", ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at"),
        "source_count", ts("last_scraped").alias("last_scraped"),
    )


def company_list_profiled(spark, sf):
    current = latest.latest_by_source(all_snapshots(spark, sf))
    return search.company_list(
        fx.companies(spark, sf), current, q="src", sort="name", order="asc"
    ).data.select("domain", "name", "source_count", ts("last_scraped").alias("last_scraped"))


def company_list_page(spark, sf):
    return _company_page(spark, sf).pagination


def _found(spark, sf, **wanted):
    return search.matching_profiles(all_snapshots(spark, sf), **wanted).select(
        "domain", "source", ts("scraped_at").alias("scraped_at")
    )


def search_uses_all(spark, sf):
    return _found(spark, sf, uses=["React", "JavaScript"])


def search_uses_any(spark, sf):
    return _found(spark, sf, uses_any=USES_ANY)


def search_excludes(spark, sf):
    return _found(spark, sf, excludes=EXCLUDES)


def search_category(spark, sf):
    return _found(spark, sf, category="payments")


def search_count(spark, sf):
    return search.matching_profiles(all_snapshots(spark, sf), uses_any=USES_ANY).agg(
        F.count("*").alias("total")
    )


def search_matched(spark, sf):
    names = [*USES, *USES_ANY]
    return all_snapshots(spark, sf).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"),
        entries_text(pf.matched(F.col("tech_profile"), names, 0.6)).alias("matched"),
    )


def _search(spark, sf, **kw):
    return search.search_stack(
        all_snapshots(spark, sf), fx.companies(spark, sf), uses_any=USES_ANY + USES,
        excludes=EXCLUDES[:1], category="language", **kw,
    )


def search_stack(spark, sf):
    return _search(spark, sf).data.select(
        "domain", "name", ts("last_scraped").alias("last_scraped"), "job_count",
        entries_text("matched_technologies").alias("matched_technologies"),
    )


def search_page(spark, sf):
    return _search(spark, sf, page=2, per_page=3).pagination


def search_second_page(spark, sf):
    return _search(spark, sf, page=2, per_page=3).data.select(
        "domain", "name", ts("last_scraped").alias("last_scraped"),
    )


def example_uses(spark, sf):
    """Presence with a test on the first entry, and the meant form with a test on the entry itself."""
    p = F.col("tech_profile")
    return all_snapshots(spark, sf).select(
        "domain", "source", ts("scraped_at").alias("scraped_at"),
        pf.first_entry_above(p, "React", 0.69).alias("first_entry"),
        pf.has_tech(p, "React", 0.69).alias("own_entry"),
    ).filter("first_entry or own_entry")


# -- report, export -------------------------------------------------------------------------

def _scrapes(spark, sf) -> DataFrame:
    """Every scrape of a run, also those without technology."""
    postings = fx.postings(spark, sf).unionByName(fx.quiet_postings(spark, sf))
    return profile.snapshot(profile.tech_profile(postings, fx.ALIASES, keep_empty=True))


def run_report(spark, sf):
    r = report.run_report(_scrapes(spark, sf), fx.companies(spark, sf))
    return r.select(
        "company_name", "domain", "source", ts("scraped_at").alias("scraped_at"), "job_count", "tech_count",
        entries_text("tech_profile").alias("tech_profile"),
        categories_text("by_category").alias("by_category"),
        F.array_join(
            F.transform(
                "top_tech",
                lambda t: F.concat_ws(":", t["name"], t["category"], F.format_number(t["confidence"], 2),
                                      t["job_mentions"].cast("string")),
            ), "|",
        ).alias("top_tech"),
    )


def run_totals(spark, sf):
    return report.run_totals(_scrapes(spark, sf))


def _export(spark, sf, **kw):
    return export.export_rows(all_snapshots(spark, sf), fx.companies(spark, sf), **kw)


def export_json(spark, sf):
    return _export(
        spark, sf, technology="Python", fields=params.EXPORT_FIELDS
    ).select(
        "domain", "name", "technologies", categories_text("categories", lambda n: n).alias("categories"),
        ts("last_scraped").alias("last_scraped"), "job_count",
    )


def export_domains(spark, sf):
    wanted = [f"src{n}.example.com" for n in range(0, 30, 3)]
    return _export(spark, sf, domains=wanted, fields=["domain", "job_count"])


def export_category(spark, sf):
    return _export(spark, sf, category="payments", fields=["domain", "technologies"])


def export_csv(spark, sf):
    rows = _export(spark, sf, fields=["domain", "name", "technologies", "categories", "last_scraped"])
    return export.csv_lines(rows)


# -- changes and upserts --------------------------------------------------------------------

def _flat_events(e: DataFrame) -> DataFrame:
    return e.select(
        "domain", "source", "event_type", "canonical", "category", "old_confidence",
        "new_confidence", ts("detected_at").alias("detected_at"),
    )


def change_events(spark, sf):
    return _flat_events(events(spark, sf))


def _merged_as_profile(snapshots: DataFrame) -> DataFrame:
    return merge.merge_profiles(snapshots).withColumn("source", F.lit("merged"))


def confidence_changes(spark, sf):
    """Merged profiles of the two versions: fewer or more boards agree."""
    old, new = versions(all_snapshots(spark, sf))
    return _flat_events(
        changes.confidence_changes(_merged_as_profile(old), _merged_as_profile(new), fx.now())
    )


def change_history(spark, sf):
    return latest.change_history(events(spark, sf)).select(
        "domain", "rank", "event_type", "canonical", "source"
    )


def recent_adopters(spark, sf):
    return latest.recent_adopters(events(spark, sf), "Kubernetes").select("domain", "source")


def change_stream(spark, sf):
    """Snapshots landed as files, streamed into events; the current version lands after the previous."""
    base = shared_dir(spark, "change-stream")
    for version in versions(all_snapshots(spark, sf)):
        version.write.mode("append").parquet(f"{base}/snapshots")
        query = change_streams.start_change_stream(
            spark, f"{base}/snapshots", f"{base}/events", f"{base}/checkpoint"
        )
        query.awaitTermination()
    return _flat_events(change_streams.settled(spark.read.parquet(f"{base}/events")))


def upsert_company(spark, sf):
    posted = fx.load(spark, sf, "documents").select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.concat(F.upper("source"), F.lit(" Inc")).alias("name"),
        F.col("doc_id").alias("ord"),
    )
    listed = fx.registry(spark, sf).select("domain", F.col("company_name").alias("name"), "ord")
    return upsert.upsert_company(
        fx.companies(spark, sf), posted.unionByName(listed), fx.now()
    ).select("domain", "name", ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at"))


def _stored_profiles(spark, sf) -> DataFrame:
    """The previous version of the posting profiles, and the header profiles."""
    old, _ = versions(all_profiles(spark, sf))
    kept = old.unionByName(hs.header_profile(fx.captures(spark, sf)))
    first = F.lit(fx.DAY0).cast("timestamp")
    return profile.snapshot(kept).withColumn("created_at", first).withColumn("updated_at", first)


def upsert_profile(spark, sf):
    _, new = versions(all_snapshots(spark, sf))
    result = upsert.upsert_profile(_stored_profiles(spark, sf), new, fx.now())
    return result.select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "job_count", "tech_count",
        joined(pf.names_of(F.col("tech_profile"))).alias("technologies"),
        ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at"),
    )


def refresh_(spark, sf):
    """A refresh of postings and captures over stored profiles; its events."""
    recent = fx.postings(spark, sf).filter(~is_old())
    fresh = refresh.fresh_profiles(recent, fx.captures(spark, sf), fx.ALIASES)
    stored = _stored_profiles(spark, sf).filter(F.col("source") != "html_headers")
    result = refresh.refresh(
        fresh, fx.registry(spark, sf), fx.companies(spark, sf), stored, fx.now()
    )
    return _flat_events(result.events)


def _refreshed(spark, sf) -> Store:
    """Two runs over an empty store, the second of them repeated; no domain is in the registry."""
    store = Store(spark, shared_dir(spark, "store"), buckets=8)
    old, new = versions(fx.postings(spark, sf))
    registry, captures = fx.registry(spark, sf), fx.captures(spark, sf)
    current.refresh_store(store, "old", old, None, registry, fx.ALIASES, F.lit(fx.SPLIT).cast("timestamp"))
    for _ in range(2):
        current.refresh_store(store, "new", new, captures, registry, fx.ALIASES, fx.now())
    return store


def refresh_companies(spark, sf):
    """The companies after the runs, from the tables they wrote."""
    return current.current_companies(_refreshed(spark, sf)).select(
        "domain", "name", ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at")
    )


def refresh_profiles(spark, sf):
    """The current profiles after the runs, with the number of events the runs logged for each."""
    store = _refreshed(spark, sf)
    logged = current.change_log(store).groupBy("domain", "source").agg(F.count("*").alias("events"))
    return current.current_profiles(store).join(logged, ["domain", "source"], "left").select(
        "domain", "source", ts("scraped_at").alias("scraped_at"), "job_count", "tech_count",
        joined(pf.names_of(F.col("tech_profile"))).alias("technologies"),
        ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at"), "events",
    )


# -- usage ----------------------------------------------------------------------------------

def monthly_usage(spark, sf):
    return usage.monthly_usage(fx.request_log(spark, sf), fx.all_keys(spark, sf), fx.now()).select(
        "key_id", ts("month").alias("month"), "requests", "monthly_limit", "remaining",
        ts("reset_at").alias("reset_at"), ts("last_used_at").alias("last_used_at"),
    )


def quota_breach(spark, sf):
    return usage.quota_breach(fx.request_log(spark, sf), fx.api_keys(spark, sf)).select(
        "request_id", "key_id", ts("ts").alias("ts"), "monthly_limit"
    )


def _flat_windows(w: DataFrame) -> DataFrame:
    return w.select("key_id", ts("window_start").alias("window_start"), "requests", "allowed", "refused")


def rate_windows(spark, sf):
    return _flat_windows(usage.rate_windows(fx.request_log(spark, sf), fx.api_keys(spark, sf)))


def rate_stream(spark, sf):
    """The request log landed as files, streamed into windows over the limit."""
    base = shared_dir(spark, "rate-stream")
    fx.request_log(spark, sf).select("ts", "key_id", "url", "status", "ms").write.parquet(f"{base}/log")
    query = rate_streams.start_rate_stream(
        spark, f"{base}/log", fx.api_keys(spark, sf), f"{base}/out", f"{base}/checkpoint"
    )
    query.awaitTermination()
    return _flat_windows(spark.read.parquet(f"{base}/out"))


def request_stats(spark, sf):
    # A mean is compared by its sum, whose two places do not hang on the order of addition.
    stats = usage.request_stats(fx.request_log(spark, sf))
    total = F.round(F.col("avg_ms") * F.col("requests"), 2)
    return stats.withColumn("total_ms", total).drop("avg_ms")


def plan_state(spark, sf):
    return billing.plan_state(fx.api_keys(spark, sf), fx.billing_events(spark, sf))


def _flat_outbox(rows: DataFrame) -> DataFrame:
    return rows.select(
        "subscription_id", "target", "event", "domain", "source", "canonical", "category", "confidence",
        F.md5("payload").alias("payload_md5"),
    )


def webhook_outbox(spark, sf):
    return _flat_outbox(webhooks.outbox(events(spark, sf), fx.subscriptions(spark, sf)))


def outbox_stream(spark, sf):
    """The change events landed as files in two parts, streamed into the outbox."""
    base = shared_dir(spark, "outbox-stream")
    found = events(spark, sf)
    found.write.parquet(f"{base}/told")  # both parts come from one reading of the documents
    told = spark.read.schema(found.schema).parquet(f"{base}/told")
    for part in (told.filter("event_type = 'added'"), told.filter("event_type <> 'added'")):
        part.write.mode("append").parquet(f"{base}/events")
        outbox_streams.start_outbox_stream(
            spark, f"{base}/events", lambda: fx.subscriptions(spark, sf), f"{base}/out", f"{base}/checkpoint"
        ).awaitTermination()
    return _flat_outbox(spark.read.parquet(f"{base}/out"))


def key_hashes(spark, sf):
    return fx.api_keys(spark, sf).select("key_id", key_hash(F.col("key_id")).alias("key_hash"))


def delivery_health(spark, sf):
    return webhooks.delivery_health(fx.delivery_log(spark, sf)).select(
        "subscription_id", ts("last_fired_at").alias("last_fired_at"), "failure_count"
    )


def run_summary(spark, sf):
    return runs.run_summary(fx.run_tasks(spark, sf)).select(
        "run_type", "attempted", "succeeded", "skipped", "failed",
        ts("started_at").alias("started_at"), ts("completed_at").alias("completed_at"),
    )


def run_errors(spark, sf):
    return runs.error_log(fx.run_tasks(spark, sf)).select("run_type", "company", "error")


def _wide(query: Query) -> Query:
    """Whole numbers as bigint, the type SQL gives them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(
            *[F.col(n).cast("bigint") if t == "int" else F.col(n) for n, t in df.dtypes]
        )

    return run


QUERIES: dict[str, Query] = {
    q.__name__.rstrip("_"): _wide(q)
    for q in (
        search_stack, ingest_board_a, ingest_board_b, html_job_links, html_job_detail,
        html_job_postings, html_pagination, search_addresses, registry_filter, discover_token_a, discover_token_b,
        worklist, registry_dedupe, strip_html_full, strip_html_short, extract_mentions,
        extract_mentions_anchor, extract_words, alias_map_, valid_domain_, header_signals,
        meta_generator_signals, header_profile, mention_rollup, score_signals, tech_profile,
        tech_profile_large,
        by_category, top_tech, profile_totals, merge_profiles, latest_profile, latest_by_source,
        profiles_by_source, company_detail, company_detail_category, company_list,
        company_list_profiled, company_list_page, search_uses_all, search_uses_any,
        search_excludes, search_category, search_count, search_matched, search_page,
        search_second_page, example_uses, run_report, run_totals, export_json, export_domains,
        export_category, export_csv, change_events, confidence_changes, change_history,
        recent_adopters, change_stream, upsert_company, upsert_profile, refresh_, refresh_companies,
        refresh_profiles, monthly_usage,
        quota_breach, rate_windows, rate_stream, request_stats, plan_state, webhook_outbox,
        outbox_stream,
        key_hashes, delivery_health, run_summary, run_errors,
    )
}

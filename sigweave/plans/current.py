"""Refresh runs over stored tables: only what a batch touches is read, compared and rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigweave import schemas
from sigweave.operators.changes import PROFILE, change_events
from sigweave.operators.profile import snapshot, unnest
from sigweave.operators.upsert import upsert_company, upsert_profile
from sigweave.plans.refresh import fresh_profiles, scraped_names
from sigweave.sources.store import Store
from sigweave.sources.taxonomy import Alias


def _same(stored: DataFrame, keys: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    return stored.join(keys, list(columns), how)


def touched_profiles(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored snapshots whose (domain, source) the batch brings, before anything is unnested or shuffled."""
    return _same(stored, fresh.select(*PROFILE).distinct(), PROFILE, "left_semi")


def refresh_store(
    store: Store,
    run_id: str,
    postings: DataFrame,
    captures: DataFrame | None,
    registry: DataFrame,
    aliases: Sequence[Alias],
    now: Column,
    confidence_changes: bool = False,
) -> bool:
    """One run over the store: companies and profiles are upserted, change events added.

    The batch's profiles are written first, so texts are searched once.  Stored rows are read from
    the buckets that the batch's domains fall into; of those, rows with other keys are copied, and
    only rows with the batch's keys meet it.  Returns False, and changes nothing, for a run id that is
    already committed; one that died before its commit starts over from the current version.
    """
    if store.committed(run_id):
        return False
    base = store.head()
    path = store.folder("profile_tech", run_id)
    fresh_profiles(postings, captures, aliases).write.mode("overwrite").parquet(path)
    fresh = store.spark.read.parquet(path)
    domains = fresh.select("domain").distinct()
    # One row a bucket: the store's number of buckets bounds it.
    touched = [r["b"] for r in domains.select(store.bucket("domain").alias("b")).distinct().collect()]

    companies = store.read("companies", schemas.COMPANY, base, touched)
    profiles = store.read("profiles", schemas.STORED_PROFILE, base, touched)
    names = scraped_names(domains, postings, captures, registry)
    mine = touched_profiles(profiles, fresh)
    others = _same(profiles, fresh.select(*PROFILE).distinct(), PROFILE, "left_anti")
    rows = upsert_profile(mine, snapshot(fresh), now).unionByName(others)
    events = change_events(unnest(mine), fresh, now, confidence_changes)
    known = _same(companies, domains, ["domain"], "left_semi")
    rest = _same(companies, domains, ["domain"], "left_anti")
    store.commit(
        base, run_id,
        {"companies": (upsert_company(known, names, now).unionByName(rest), ["domain"]), "profiles": (rows, ["domain"])},
        {"events": events}, touched,
    )
    return True


def current_companies(store: Store) -> DataFrame:
    return store.read("companies", schemas.COMPANY)


def current_profiles(store: Store) -> DataFrame:
    """The profile of each (domain, source) as of the last committed run; what searches and exports read."""
    return store.read("profiles", schemas.STORED_PROFILE)


def change_log(store: Store) -> DataFrame:
    """The change events of all committed runs."""
    return store.read_added("events", schemas.CHANGE_EVENT)

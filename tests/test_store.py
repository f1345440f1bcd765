"""Runs over stored tables: what they touch, repeat, lose and log."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigweave import schemas
from sigweave.operators.changes import change_events
from sigweave.operators.profile import unnest
from sigweave.plans import current
from sigweave.sources.store import Store
from sigweave.sources.taxonomy import default_aliases

POSTING = (
    "domain string, company_name string, source string, scraped_at timestamp, posting_id string, pos bigint, "
    "title string, description string"
)


def run(spark, store, name, at, rows, **kw):
    """Rows of (domain, company, words); one posting each."""
    postings = spark.createDataFrame(
        [(d, c, "lever", at, str(i), i, "Dev", text) for i, (d, c, text) in enumerate(rows)], POSTING
    )
    registry = spark.createDataFrame([("Listed", "listed.com", 0)], "company_name string, domain string, ord int")
    return current.refresh_store(store, name, postings, None, registry, default_aliases(), F.lit(at), **kw)


def profiles(store):
    return {r.domain: [e.canonical for e in r.tech_profile] for r in current.current_profiles(store).collect()}


def log(store):
    return sorted((r.domain, r.event_type, r.canonical) for r in current.change_log(store).collect())


def files(root, table):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(root, table).rglob("*.parquet")}


def test_runs_upsert_log_and_repeat(spark, t, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert profiles(store) == {} and log(store) == []
    assert run(spark, store, "r1", t(1), [("a.com", "A", "React"), ("listed.com", None, "Go"), ("x.com", None, "Rust")])
    first = [("a.com", "added", "React"), ("listed.com", "added", "Go"), ("x.com", "added", "Rust")]
    assert log(store) == first
    # A company is named by its scrape, then by the registry, then by its domain.
    names = {r.domain: (r.name, r.created_at, r.updated_at) for r in current.current_companies(store).collect()}
    assert names == {"a.com": ("A", t(1), t(1)), "listed.com": ("Listed", t(1), t(1)), "x.com": ("x.com", t(1), t(1))}

    assert run(spark, store, "r2", t(2), [("a.com", "A2", "Docker"), ("b.com", "B", "React"), ("x.com", "X", "nothing here")])
    assert profiles(store) == {"a.com": ["Docker"], "listed.com": ["Go"], "x.com": ["Rust"], "b.com": ["React"]}
    second = sorted([*first, ("a.com", "added", "Docker"), ("a.com", "removed", "React"), ("b.com", "added", "React")])
    assert log(store) == second
    names = {r.domain: (r.name, r.created_at, r.updated_at) for r in current.current_companies(store).collect()}
    assert names["a.com"] == ("A2", t(1), t(2)) and names["x.com"] == ("x.com", t(1), t(1)) and names["b.com"][0] == "B"

    before = files(store.root, "")
    assert not run(spark, store, "r1", t(3), [("a.com", "A3", "Rust")])
    assert not run(spark, store, "r2", t(3), [("a.com", "A3", "Rust")])
    assert files(store.root, "") == before and log(store) == second


def test_untouched_buckets_keep_their_files(spark, t, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    run(spark, store, "r1", t(1), [(f"d{i}.com", "D", "React") for i in range(40)])
    before, base = files(store.root, "profiles"), store.head()
    run(spark, store, "r2", t(2), [("d3.com", "D", "Docker")])
    head = store.head()
    changed = {k for k in head.folders if head.folders[k] != base.folders[k]}
    mine = spark.createDataFrame([("d3.com",)], "d string").select(store.bucket("d"))
    assert changed == {(name, mine.first()[0]) for name in ("companies", "profiles")}
    assert {k: v for k, v in files(store.root, "profiles").items() if k in before} == before
    assert len(files(store.root, "profiles")) == len(before) + 1
    got = profiles(store)
    assert len(got) == 40 and got.pop("d3.com") == ["Docker"] and set(map(tuple, got.values())) == {("React",)}


def test_stored_profiles_are_filtered_before_they_are_unnested_and_shuffled(spark, t, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    run(spark, store, "r1", t(1), [(f"d{i}.com", "D", "React Docker") for i in range(20)])
    stored = current.current_profiles(store)
    spark.createDataFrame(
        [("d1.com", "lever", "Go", "language", 0.7)], "domain string, source string, canonical string, category string, confidence double"
    ).write.parquet(str(tmp_path / "fresh"))
    fresh = spark.read.parquet(str(tmp_path / "fresh"))
    mine = current.touched_profiles(stored, fresh)
    plan = change_events(unnest(mine), fresh, F.lit(t(2)))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = lambda word: next(i for i, line in enumerate(lines) if word in line)
    # Read upwards: scan, semi join with the batch's keys, generate, exchange.
    assert at("Exchange hashpartitioning(domain") < at("Generate posexplode") < at("BroadcastHashJoin") < at("FileScan parquet")
    assert mine.count() == 1


def test_a_run_that_died_leaves_nothing(spark, t, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    run(spark, store, "r1", t(1), [("a.com", "A", "React")])
    whole = Store._versions

    def dies(self, *a, **kw):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "coalesce", dies)
        with pytest.raises(OSError):
            run(spark, store, "r2", t(2), [("a.com", "A", "Docker")])
    assert Store._versions is whole and profiles(store) == {"a.com": ["React"]} and len(log(store)) == 1
    assert run(spark, store, "r2", t(2), [("a.com", "A", "Rust")])
    assert profiles(store) == {"a.com": ["Rust"]}
    assert log(store) == [("a.com", "added", "React"), ("a.com", "added", "Rust"), ("a.com", "removed", "React")]


def test_two_runs_from_one_version_cannot_both_commit(spark, t, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    run(spark, store, "r1", t(1), [("a.com", "A", "React")])
    base, events = store.head(), spark.createDataFrame([], schemas.CHANGE_EVENT)
    store.commit(base, "r2", {}, {"events": events}, [])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.commit(base, "r3", {}, {"events": events}, [])
    assert store.committed("r2") and not store.committed("r3") and profiles(store) == {"a.com": ["React"]}


def test_a_run_without_technologies(spark, t, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert run(spark, store, "r0", t(1), [("a.com", "A", "nothing")])
    assert profiles(store) == {} and store.committed("r0")
    assert run(spark, store, "r1", t(2), [("a.com", "A", "React")]) and profiles(store) == {"a.com": ["React"]}

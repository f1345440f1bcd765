from datetime import datetime, timedelta

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sigweave.operators import changes, profile, usage
from sigweave.plans.refresh import run_refresh
from sigweave.schemas import REQUEST_LOG, SNAPSHOT
from sigweave.sources.taxonomy import default_aliases
from sigweave.streaming import changes as change_streams, rates


def tech(name, x=0.7):
    return (name, "c", x, ["job_listing"], 1, 0.5)


def test_change_stream_equals_batch_and_survives_a_restart(spark, t, tmp_path):
    versions = [
        [("a", "s", t(1), 1, 2, [tech("A"), tech("B")]), ("b", "s", t(1), 1, 1, [tech("X")])],
        [("a", "s", t(2), 1, 2, [tech("B", 0.8), tech("C")]), ("b", "s", t(2), 1, 0, [])],
        [("b", "s", t(3), 1, 1, [tech("Y")]), ("c", "s", t(3), 1, 1, [tech("Z")])],
    ]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in versions:
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        change_streams.start_change_stream(spark, src, out, check).awaitTermination()
    got = sorted((r.domain, r.event_type, r.canonical, r.old_confidence, r.new_confidence, r.detected_at)
                 for r in spark.read.parquet(out).collect())
    expected, stored = [], spark.createDataFrame([], SNAPSHOT)
    for n, rows in enumerate(versions):
        new = spark.createDataFrame(rows, SNAPSHOT)
        diff = changes.change_events(profile.unnest(stored), profile.unnest(new), F.lit(t(n + 1)))
        expected += [(r.domain, r.event_type, r.canonical, r.old_confidence, r.new_confidence, r.detected_at)
                     for r in diff.collect()]
        filled = new.filter("tech_count > 0")
        stored = stored.join(filled.select("domain", "source"), ["domain", "source"], "left_anti") \
            .select(*new.columns).unionByName(filled)
    assert got == sorted(expected) and len(got) == 8


class State:
    """Keyed state of one profile."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def streamed(batches, horizon=10**9, confidence_changes=True):
    """What stays of the events of one profile; a batch is a list of (time, {technology: confidence})."""
    state, rows = State(), []
    for batch in batches:
        frame = pd.DataFrame(
            [(at, list(p), ["c"] * len(p), list(p.values())) for at, p in batch], columns=["at", "names", "categories", "confidences"]
        )
        for out in change_streams._diff(("d", "s"), [frame], state, horizon, confidence_changes):
            rows += list(out.itertuples(index=False))
    last = {}
    for r in rows:
        last[r.detected_at] = max(last.get(r.detected_at, 0), r.revision)
    number = lambda x: 0 if pd.isna(x) else x
    return sorted((r.detected_at, r.event_type, r.canonical, number(r.old_confidence), number(r.new_confidence))
                  for r in rows if r.revision == last[r.detected_at] and r.event_type)


versions_of_a_profile = st.lists(
    st.tuples(st.integers(0, 12), st.dictionaries(st.sampled_from("ABC"), st.sampled_from([0.7, 0.8]), max_size=3)), max_size=9
)


@settings(max_examples=150, deadline=None)
@given(versions_of_a_profile, st.data())
def test_events_do_not_hang_on_the_split_of_the_input(versions, data):
    shuffled = data.draw(st.permutations(versions))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(shuffled)), max_size=4)))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(shuffled)])]
    got = streamed(batches)
    assert got == streamed([sorted(versions, key=lambda v: v[0])]) == streamed([[v] for v in reversed(versions)])
    # Applied in order, the events lead from each version to the next.
    known, by = {}, {}
    for at, p in versions:
        if p:
            by[at] = max(by.get(at, {}), p, key=lambda x: sorted(x.items()))
    for at in sorted(by):
        for when, kind, name, _, new in got:
            if when == pd.Timestamp(at, unit="us"):
                known = {k: v for k, v in known.items() if k != name} | ({} if kind == "removed" else {name: new})
        assert known == by[at]


def test_what_is_older_than_the_horizon_is_dropped():
    batches = [[(0, {"A": 0.7})], [(50, {"B": 0.7})], [(100, {"C": 0.7})], [(10, {"X": 0.7})], [(60, {"B": 0.7, "D": 0.7})]]
    got = streamed(batches, horizon=45)
    assert [(r[0].value // 1000, r[1], r[2]) for r in got] == [
        (0, "added", "A"), (50, "added", "B"), (50, "removed", "A"), (60, "added", "D"),
        (100, "added", "C"), (100, "removed", "B"), (100, "removed", "D"),
    ]


def test_late_snapshots_through_the_stream(spark, t, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    arriving = [
        [("a", "s", t(2), 1, 1, [tech("B")])], [("a", "s", t(1), 1, 1, [tech("A")]), ("b", "s", t(5), 1, 1, [tech("X")])],
        [("b", "s", t(4), 1, 1, [tech("X", 0.9)]), ("a", "s", t(3), 1, 0, [])],
    ]
    for rows in arriving:
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        change_streams.start_change_stream(spark, src, out, check, confidence_changes=True).awaitTermination()
    got = change_streams.settled(spark.read.parquet(out))
    assert "revision" not in got.columns
    assert sorted((r.domain, r.detected_at, r.event_type, r.canonical, r.old_confidence, r.new_confidence) for r in got.collect()) == [
        ("a", t(1), "added", "A", None, 0.7), ("a", t(2), "added", "B", None, 0.7), ("a", t(2), "removed", "A", 0.7, None),
        ("b", t(4), "added", "X", None, 0.9), ("b", t(5), "confidence_change", "X", 0.9, 0.7),
    ]


def test_rate_stream_equals_batch_for_closed_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=i * 7), f"k{i % 3}", "/x", 200, 1.0) for i in range(400)]
    rows.append((start + timedelta(hours=5), "end", "/x", 200, 1.0))
    keys = spark.createDataFrame([("k0", 2), ("k1", 1)], "key_id string, requests_per_minute int")
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    log = spark.createDataFrame(rows, REQUEST_LOG)
    log.coalesce(1).write.parquet(src)
    rates.start_rate_stream(spark, src, keys, out, check).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, usage.rate_windows(log, keys).collect())) and got


def test_refresh_can_be_repeated(spark, t, tmp_path):
    postings = spark.createDataFrame(
        [("a.com", "lever", t(5), "1", 0, "Dev", "React and Go"), ("b.com", "lever", t(5), "2", 0, "Dev", "nothing")],
        "domain string, source string, scraped_at timestamp, posting_id string, pos bigint, title string, description string")
    captures = spark.createDataFrame(
        [("c.com", "C", {"server": "nginx"}, "", t(5))],
        "domain string, company_name string, headers map<string,string>, body string, scraped_at timestamp")
    registry = spark.createDataFrame(
        [("A", "a.com", 0), ("B", "b.com", 1), ("C", "c.com", 2)], "company_name string, domain string, ord int")
    companies = spark.createDataFrame(
        [("a.com", "old", t(1), t(1))], "domain string, name string, created_at timestamp, updated_at timestamp")
    stored = spark.createDataFrame([("a.com", "lever", t(1), 1, 2, [tech("Go"), tech("Rust")])], SNAPSHOT) \
        .withColumn("created_at", F.lit(t(1))).withColumn("updated_at", F.lit(t(1)))
    out = str(tmp_path / "out")
    for _ in range(2):
        run_refresh(spark, postings, captures, registry, companies, stored, default_aliases(),
                    F.lit(t(6)), out, "r1")
    events = {(r.domain, r.event_type, r.canonical) for r in spark.read.parquet(f"{out}/events/run=r1").collect()}
    assert events == {("a.com", "added", "React"), ("a.com", "removed", "Rust"), ("c.com", "added", "Nginx")}
    # A scrape without technologies stores nothing, not even its company.
    assert {(r.domain, r.name) for r in spark.read.parquet(f"{out}/companies").collect()} == {("a.com", "A"), ("c.com", "C")}
    assert spark.read.parquet(f"{out}/profiles").count() == 2

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sigweave.operators import changes, latest, merge, upsert
from sigweave.schemas import SNAPSHOT

PT = "domain string, source string, canonical string, category string, confidence double"


def entry(name, confidence=0.7, category="c", sources=("job_listing",), count=1, freq=0.5):
    return (name, category, confidence, list(sources), count, freq)


def snapshots(spark, rows):
    return spark.createDataFrame(
        [(d, s, at, n, len(e), e) for d, s, at, n, e in rows], SNAPSHOT
    )


def test_merge_boosts_per_further_profile(spark, t):
    df = snapshots(spark, [
        ("a.com", "lever", t(3), 2, [entry("X", 0.7, count=3), entry("Y", 0.95)]),
        ("a.com", "greenhouse", t(2), 2, [entry("X", 0.9, freq=0.9)]),
        ("a.com", "indeed", t(1), 2, [entry("X", 0.6, sources=["other"], category="old")]),
        ("a.com", "indeed", t(0 + 1, 1), 2, []),
    ])
    rows = {r.canonical: r for r in merge.merge_profiles(df).collect()}
    x = rows["X"]
    # The newest row's 0.70 is the base, not the highest; the empty indeed profile replaced the older one.
    assert (x.confidence, x.category, x.sources) == (0.75, "c", ["job_listing"])
    assert (x.job_mention_count, x.job_mention_frequency, x.last_scraped) == (3, 0.9, t(3))
    assert rows["Y"].confidence == 0.95


def test_merge_of_three_and_the_cap(spark, t):
    df = snapshots(spark, [
        ("a.com", s, t(d), 1, [entry("X", 0.7, sources=[s]), entry("Y", 0.96)])
        for s, d in (("lever", 3), ("greenhouse", 2), ("indeed", 1))
    ])
    rows = {r.canonical: r for r in merge.merge_profiles(df).collect()}
    assert (rows["X"].confidence, rows["X"].sources) == (0.8, ["lever", "greenhouse", "indeed"])
    assert rows["Y"].confidence == 0.99


def test_latest(spark, t):
    df = snapshots(spark, [
        ("a.com", "lever", t(1), 1, []), ("a.com", "lever", t(5), 2, []), ("a.com", "indeed", t(5), 3, []),
        ("b.com", "lever", t(2), 4, []),
    ])
    assert {(r.domain, r.job_count) for r in latest.latest_profile(df).collect()} == {("a.com", 3), ("b.com", 4)}
    assert {r.job_count for r in latest.latest_by_source(df).collect()} == {2, 3, 4}


def pt(spark, rows):
    return spark.createDataFrame([(d, s, c, "cat", x) for d, s, c, x in rows], PT)


def events(spark, old, new, **kw):
    out = changes.change_events(pt(spark, old), pt(spark, new), F.lit("2024-02-01"), **kw)
    return {(r.event_type, r.canonical, r.old_confidence, r.new_confidence) for r in out.collect()}


def test_added_and_removed(spark):
    old = [("a", "s", "A", 0.7), ("a", "s", "B", 0.7)]
    new = [("a", "s", "B", 0.9), ("a", "s", "C", 0.7)]
    expected = {("removed", "A", 0.7, None), ("added", "C", None, 0.7)}
    assert events(spark, old, new) == expected
    assert events(spark, old, new, confidence_changes=True) == expected | {("confidence_change", "B", 0.7, 0.9)}


def test_empty_new_profile_is_silent_and_first_profile_is_all_added(spark):
    assert events(spark, [("a", "s", "A", 0.7)], []) == set()
    assert events(spark, [("a", "s", "A", 0.7)], [("b", "s", "Z", 0.7)]) == {("added", "Z", None, 0.7)}


def test_a_diff_is_one_shuffle(spark):
    df = changes.change_events(pt(spark, []), pt(spark, []), F.lit("2024-02-01"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


profile_sets = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from("st"), st.sampled_from("ABCDE")), unique=True, max_size=12
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(profile_sets, profile_sets)
def test_events_turn_the_old_profile_into_the_new(spark, old, new):
    refreshed = {k[:2] for k in new}
    old_df = pt(spark, [(*k, 0.7) for k in old])
    diff = changes.change_events(old_df, pt(spark, [(*k, 0.7) for k in new]), F.lit("2024-02-01"))
    after = {tuple(r) for r in changes.replay(old_df, diff).collect()}
    assert after == set(new) | {k for k in old if k[:2] not in refreshed}


def test_history_and_adopters(spark, t):
    rows = [("a.com", "s", "added", f"T{i:03d}", "c", None, 0.7, t(1 + i % 20)) for i in range(150)]
    df = spark.createDataFrame(
        rows, "domain string, source string, event_type string, canonical string, category string,"
        " old_confidence double, new_confidence double, detected_at timestamp")
    assert latest.change_history(df).count() == 150
    history = latest.change_history(df, 100).collect()
    assert len(history) == 100
    assert min(r.detected_at for r in history) >= sorted((r[7] for r in rows), reverse=True)[99]
    assert [r.domain for r in latest.recent_adopters(df, "T005").collect()] == ["a.com"]


def test_upsert_company(spark, t):
    stored = spark.createDataFrame(
        [("a", "A", t(1), t(1)), ("b", "B", t(1), t(2))],
        "domain string, name string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame(
        [("b", "B1", 1), ("b", "B2", 2), ("c", "C", 3)], "domain string, name string, ord int")
    got = {tuple(r) for r in upsert.upsert_company(stored, batch, F.lit(t(9))).collect()}
    assert got == {("a", "A", t(1), t(1)), ("b", "B2", t(1), t(9)), ("c", "C", t(9), t(9))}


def test_upsert_profile(spark, t):
    stored = snapshots(spark, [
        ("a", "s", t(1), 1, [entry("X")]), ("b", "s", t(1), 1, [entry("Y")]),
    ]).withColumn("created_at", F.lit(t(1))).withColumn("updated_at", F.lit(t(1)))
    batch = snapshots(spark, [("a", "s", t(2), 5, []), ("c", "s", t(2), 6, [entry("Z")])])
    got = {r.domain: (r.job_count, r.created_at, r.updated_at, r.tech_count)
           for r in upsert.upsert_profile(stored, batch, F.lit(t(9))).collect()}
    assert got == {"a": (5, t(1), t(9), 0), "b": (1, t(1), t(1), 1), "c": (6, t(9), t(9), 1)}

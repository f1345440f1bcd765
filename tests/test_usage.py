import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigweave.operators import billing, runs, usage, webhooks
from sigweave.schemas import CHANGE_EVENT
from sigweave.streaming import outbox as outbox_streams

KEYS = "key_id string, monthly_limit int, requests_per_minute int"


@pytest.fixture(scope="module")
def log_rows():
    rng = random.Random(3)
    start = datetime(2024, 1, 20)
    # Half of all requests belong to one key; many share a second.
    return [
        (i, start + timedelta(seconds=rng.randrange(20 * 86_400) // (1 + 400 * (i % 3 == 0))),
         "hot" if i % 2 else f"k{i % 5}", "/x", rng.choice([200, 404, 500]), float(i % 100))
        for i in range(1500)
    ]


@pytest.fixture(scope="module")
def log(spark, log_rows):
    return spark.createDataFrame(
        log_rows, "request_id int, ts timestamp, key_id string, url string, status int, ms double")


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(
        [("hot", 100, 2), ("k0", 10, None), ("k2", 60, 1), ("k4", 1000, 1)], KEYS)


def test_quota(log, keys, log_rows):
    limits = {"hot": 100, "k0": 10, "k2": 60, "k4": 1000}
    used, refused = defaultdict(int), set()
    for request_id, ts, key, *_ in sorted(log_rows, key=lambda r: (r[1], r[0])):
        if key not in limits:
            continue
        if used[key, ts.month] >= limits[key]:
            refused.add(request_id)
        else:
            used[key, ts.month] += 1
    assert {r.request_id for r in usage.quota_breach(log, keys).collect()} == refused
    assert len(refused) > 300


def test_monthly_usage(log, keys, log_rows):
    rows = {(r.key_id, r.month.month): r for r in usage.monthly_usage(log, keys).collect()}
    mine = [r for r in log_rows if r[2] == "hot" and r[1].month == 1]
    hot = rows["hot", 1]
    # Refused requests neither count nor set the last use.
    assert len(mine) > 100
    assert (hot.requests, hot.remaining, hot.last_used_at) == (100, 0, sorted(r[1] for r in mine)[99])
    assert str(hot.reset_at) == "2024-02-01 00:00:00"


def test_rate_windows(log, keys, log_rows):
    allowed = {"hot": 2, "k2": 1, "k4": 1}
    counts = defaultdict(int)
    for _, ts, key, *_ in log_rows:
        counts[key, ts.replace(second=0, microsecond=0)] += 1
    expected = {(k, w, n) for (k, w), n in counts.items() if n > allowed.get(k, 60)}
    got = {(r.key_id, r.window_start, r.requests) for r in usage.rate_windows(log, keys).collect()}
    assert got == expected and got


def test_request_stats(log, log_rows):
    row = next(r for r in usage.request_stats(log).collect() if r.key_id == "hot")
    mine = [r for r in log_rows if r[2] == "hot"]
    assert row.requests == len(mine)
    assert (row.succeeded, row.client_errors, row.server_errors) == tuple(
        sum(r[4] == s for r in mine) for s in (200, 404, 500))


def test_plan_state(spark):
    keys = spark.createDataFrame(
        [(k, "starter", 60, 1000, "c0", "s0") for k in "abcdef"],
        "key_id string, plan string, requests_per_minute int, monthly_limit int, customer string, subscription string")
    done, upd, gone = billing.COMPLETED, billing.UPDATED, billing.DELETED
    events = [
        (1, done, "a", "pro", None, "c1", "s1"), (2, upd, "a", "enterprise", "past_due", None, None),
        (3, done, "b", "pro", None, None, "s2"), (4, gone, "b", None, None, None, None),
        (5, upd, "c", "enterprise", "active", "cX", "sX"),
        (6, done, "d", "gold", None, "c9", "s9"), (7, "invoice.payment_failed", "d", "pro", None, "c8", "s8"),
        (8, gone, "e", "pro", None, None, None), (9, done, "e", "enterprise", None, "c7", "s7"),
        (10, done, None, "pro", None, "c", "s"),
    ]
    df = spark.createDataFrame(
        events, "seq int, type string, key_id string, plan string, status string, customer string, subscription string")
    got = {r.key_id: tuple(r)[1:] for r in billing.plan_state(keys, df).collect()}
    assert got == {
        "a": ("pro", 300, 10000, "c1", "s1"),
        "b": ("starter", 60, 1000, None, None),
        "c": ("enterprise", 1000, 999999999, "c0", "s0"),
        "d": ("starter", 60, 1000, "c0", "s0"),
        "e": ("enterprise", 1000, 999999999, "c7", "s7"),
        "f": ("starter", 60, 1000, "c0", "s0"),
    }


def test_outbox(spark, t):
    events = spark.createDataFrame(
        [("a", "s", "added", "X", "c", None, 0.7, t(1)), ("a", "s", "removed", "Y", "c", 0.6, None, t(1)),
         ("b", "s", "added", "Z", "c", None, 0.7, t(1)), ("b", "s", "confidence_change", "W", "c", 0.7, 0.8, t(1))],
        "domain string, source string, event_type string, canonical string, category string,"
        " old_confidence double, new_confidence double, detected_at timestamp")
    subs = spark.createDataFrame(
        [("all", "u", ["tech_added", "tech_removed", "tech_added"], None, True), ("b", "u", ["tech_added", "confidence_change"], ["b", "b"], True),
         ("off", "u", ["tech_added"], None, False), ("none", "u", ["tech_added"], [], True)],
        "id string, url string, events array<string>, domains array<string>, is_active boolean")
    rows = webhooks.outbox(events, subs).collect()
    assert sorted((r.subscription_id, r.canonical) for r in rows) == [
        ("all", "X"), ("all", "Y"), ("all", "Z"), ("b", "W"), ("b", "Z")]
    x = next(r for r in rows if r.canonical == "Y")
    assert x.payload == (
        '{"event":"tech_removed","domain":"a","canonical":"Y","category":"c","confidence":0.6,'
        '"detected_at":"2024-01-01T00:00:00.000Z"}')


def test_delivery_health(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(1200), microseconds=i)
        rows.append((ts, f"s{i % 4}", i % 4 != 3 and rng.random() < 0.05))
    expected = {}
    for ts, sub, ok in sorted(rows):
        fired, failed = expected.get(sub, (None, 0))
        expected[sub] = (ts, 0) if ok else (fired, failed + 1)
    df = spark.createDataFrame(rows, "ts timestamp, subscription_id string, ok boolean")
    got = {r.subscription_id: (r.last_fired_at, r.failure_count) for r in webhooks.delivery_health(df).collect()}
    assert got == expected


def test_delivery_health_shuffles_no_row_of_the_log(spark, t):
    rows = [(t(1, 0, m), None if m % 2 else "s", ok) for m, ok in enumerate([False, True, False, None, False, False])]
    health = webhooks.delivery_health(spark.createDataFrame(rows, "ts timestamp, subscription_id string, ok boolean"))
    assert {tuple(r) for r in health.collect()} == {("s", None, 3), (None, t(1, 0, 1), 1)}
    plan = health._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert below and all("HashAggregate" in line for line in below) and any("BroadcastHashJoin" in line for line in plan)


def test_runs(spark, t):
    df = spark.createDataFrame(
        [("lever", "A", "ok", None, t(1), t(2)), ("lever", "B", "fail", "boom", t(3), t(4)), ("lever", "C", "skip", None, t(3), t(5))],
        "run_type string, company string, status string, error string, started_at timestamp, completed_at timestamp")
    assert tuple(runs.run_summary(df).collect()[0]) == ("lever", 3, 1, 1, 1, t(1), t(5))
    assert [r.error for r in runs.error_log(df).collect()] == ["boom"]


def test_outbox_splits_only_scopes_with_many_events(spark, t):
    rows = [("hot.com", "s", "added", f"T{i}", "c", None, 0.7, t(1)) for i in range(300)]
    rows += [(f"d{i}.com", "s", "removed", "T", "c", 0.7, None, t(1)) for i in range(20)]
    events = spark.createDataFrame(rows, CHANGE_EVENT)
    subs = spark.createDataFrame(
        [("all", "k", "u1", ["tech_added", "tech_removed"], None, True), ("hot", "k", "u2", ["tech_added"], ["hot.com", "none.com"], True),
         ("cold", "k", "u3", ["tech_removed"], ["d3.com"], True), ("off", "k", "u4", ["tech_added"], None, False)],
        "id string, key_id string, url string, events array<string>, domains array<string>, is_active boolean")
    got = [{tuple(r) for r in webhooks.outbox(events, subs, n).collect()} for n in (1, 7, 10**6)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 300 + 20 + 300 + 1


def test_outbox_deals_many_subscriptions_of_one_scope_to_several_tasks(spark, t):
    events = spark.createDataFrame(
        [("hot.com", "s", "added", f"T{i}", "c", None, 0.7, t(1)) for i in range(5)] + [(None, "s", "added", "T", "c", None, 0.7, t(1))], CHANGE_EVENT)
    subs = spark.createDataFrame(
        [(f"s{i}", "k", "u", ["tech_added"], ["hot.com"], True) for i in range(400)] + [(None, "k", "u", ["tech_added"], ["hot.com"], True)] * 2,
        "id string, key_id string, url string, events array<string>, domains array<string>, is_active boolean").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [webhooks.outbox(events, subs, n, m) for n, m in ((50_000, 100), (2, 7), (1, 1), (50_000, 10**6))]
        got = [sorted(map(str, r.collect())) for r in rows]
        tasks = rows[0].select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 402 * 5 and tasks > 1


def test_outbox_stream_delivers_each_event_once(spark, t, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kinds = "id string, key_id string, url string, events array<string>, domains array<string>, is_active boolean"
    subs = [[("s1", "k", "u", ["tech_added"], None, True)], [("s1", "k", "u", ["tech_added"], None, True), ("s2", "k", "v", ["tech_added"], ["b.com"], True)]]
    told = [
        [("a.com", "s", "added", "X", "c", None, 0.7, t(1)), ("a.com", "s", None, None, None, None, None, t(1))],
        [("b.com", "s", "added", "Y", "c", None, 0.7, t(2)), ("b.com", "s", "removed", "X", "c", 0.7, None, t(2))],
    ]
    for rows, now in zip(told, subs):
        spark.createDataFrame(rows, CHANGE_EVENT).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):  # the second finds nothing new
            outbox_streams.start_outbox_stream(spark, src, lambda: spark.createDataFrame(now, kinds), out, check).awaitTermination()
    got = sorted((r.subscription_id, r.domain, r.canonical) for r in spark.read.parquet(out).collect())
    assert got == [("s1", "a.com", "X"), ("s1", "b.com", "Y"), ("s2", "b.com", "Y")]


def test_usage_of_idle_inactive_and_limited_keys(spark, t):
    log = spark.createDataFrame(
        [(1, t(3, 1), "two"), (2, t(3, 2), "two"), (3, t(3, 3), "two"), (4, t(4), "off"), (5, t(5), "open"), (6, t(6), "nobody"), (7, t(7), "zero")],
        "request_id long, ts timestamp, key_id string")
    keys = spark.createDataFrame(
        [("two", 2, True), ("idle", 5, True), ("off", 5, False), ("open", None, None), ("zero", 0, True)],
        "key_id string, monthly_limit int, is_active boolean")
    rows = {r.key_id: (r.requests, r.remaining, r.last_used_at) for r in usage.monthly_usage(log, keys, F.lit(t(20))).collect()}
    assert rows == {
        "two": (2, 0, t(3, 2)), "idle": (0, 5, None), "off": (0, 5, None), "open": (1, None, t(5)), "zero": (0, 0, None),
    }
    assert {r.key_id for r in usage.monthly_usage(log, keys).collect()} == {"two", "open", "zero"}

"""API usage from request logs: monthly counts, quota, rate limits, statistics.

One key may own a large share of the log.  Counts have a map-side half; where an order matters
(the quota), requests are split by minute, so no task ever sees all requests of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Limit per minute of a key that states none.
DEFAULT_PER_MINUTE = 60


def month_start(col: str = "ts"):
    return F.date_trunc("month", F.col(col))


def _active(keys: DataFrame) -> Column:
    """Whether a key's requests are let in at all; keys that do not say are active."""
    return F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in keys.columns else F.lit(True)


def monthly_usage(log: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """Accepted requests, remaining quota, reset time and last accepted use per key and calendar month.

    Requests over the quota are refused and do not count, nor do those of a deactivated key or of no
    key; a key without a limit has none to reach, and no remaining number.  Every key has a row for the month of ``now``, where given, used or not.  The request that
    reaches a limit is looked up in its own minute; all else comes from counts per minute, so a key
    with most of the log is no task of its own.
    """
    limits = keys.select("key_id", "monthly_limit", _active(keys).alias("active"))
    minute = F.date_trunc("minute", F.col("ts"))
    so_far = Window.partitionBy("key_id", month_start("minute")).orderBy("minute")
    per_minute = (
        log.groupBy("key_id", minute.alias("minute"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        .join(limits.filter("active"), "key_id")
        .withColumn("total", F.sum("n").over(so_far))
    )
    before = F.col("total") - F.col("n")
    reaching = per_minute.filter((F.col("total") >= F.col("monthly_limit")) & (before < F.col("monthly_limit"))).select(
        "key_id", "minute", (F.col("monthly_limit") - before).alias("needed")
    )
    within = Window.partitionBy("key_id", "minute").orderBy("ts")
    reached = (
        log.select("key_id", "ts", minute.alias("minute"))
        .join(reaching, ["key_id", "minute"])
        .withColumn("position", F.row_number().over(within))
        .filter(F.col("position") == F.col("needed"))
        .select("key_id", month_start().alias("month"), F.col("ts").alias("reached_at"))
    )
    used = (
        per_minute.groupBy("key_id", month_start("minute").alias("month"))
        .agg(F.sum("n").alias("asked"), F.max("last").alias("last"))
        .join(reached, ["key_id", "month"], "left")
    )
    if now is not None:
        every = keys.select("key_id", F.date_trunc("month", now).alias("month"))
        used = used.join(every, ["key_id", "month"], "full_outer")
    accepted = F.least(F.coalesce("asked", F.lit(0)), F.greatest("monthly_limit", F.lit(0)))
    limited = F.col("monthly_limit").isNotNull()
    return used.join(limits, "key_id").withColumn("requests", F.when(limited, accepted).otherwise(F.coalesce("asked", F.lit(0)))).select(
        "key_id", "month", "requests", "monthly_limit",
        F.when(limited, F.greatest(F.lit(0), F.col("monthly_limit") - F.col("requests"))).alias("remaining"),
        F.add_months("month", 1).cast("timestamp").alias("reset_at"),
        F.when(F.col("requests") > 0, F.coalesce("reached_at", "last")).alias("last_used_at"),
    )


def quota_breach(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests refused by the monthly quota.

    Refused requests do not count, so the first ``monthly_limit`` of a month are accepted.  Counts
    per minute and a running total over minutes (a bounded list per key and month) find the minutes
    at or past the limit; only their requests are ranked, each minute on its own.
    """
    minute = F.date_trunc("minute", F.col("ts"))
    per_minute = (
        log.groupBy("key_id", minute.alias("minute"))
        .agg(F.count("*").alias("n"))
        .join(keys.select("key_id", "monthly_limit"), "key_id")
    )
    so_far = Window.partitionBy("key_id", month_start("minute")).orderBy("minute")
    over = (
        per_minute.withColumn("total", F.sum("n").over(so_far))
        .filter(F.col("total") > F.col("monthly_limit"))
        .select("key_id", "minute", "monthly_limit", (F.col("total") - F.col("n")).alias("before"))
    )
    within = Window.partitionBy("key_id", "minute").orderBy("ts", "request_id")
    return (
        log.withColumn("minute", minute)
        .join(over, ["key_id", "minute"])
        .withColumn("position", F.col("before") + F.row_number().over(within))
        .filter(F.col("position") > F.col("monthly_limit"))
        .select("request_id", "key_id", "ts", "monthly_limit")
    )


def rate_windows(log: DataFrame, keys: DataFrame) -> DataFrame:
    """One-minute windows in which a key made more requests than its limit allows."""
    counts = log.groupBy(F.window("ts", "1 minute").alias("w"), "key_id").agg(
        F.count("*").alias("requests")
    )
    return over_limit(counts, keys)


def over_limit(counts: DataFrame, keys: DataFrame) -> DataFrame:
    limit = F.coalesce(F.col("requests_per_minute"), F.lit(DEFAULT_PER_MINUTE))
    return (
        counts.join(keys.select("key_id", "requests_per_minute"), "key_id", "left")
        .withColumn("allowed", limit)
        .filter(F.col("requests") > F.col("allowed"))
        .select(
            "key_id",
            F.col("w.start").alias("window_start"),
            "requests",
            "allowed",
            (F.col("requests") - F.col("allowed")).alias("refused"),
        )
    )


def request_stats(log: DataFrame) -> DataFrame:
    """Requests, status classes and latency per key."""
    status = F.col("status")
    return log.groupBy("key_id").agg(
        F.count("*").alias("requests"),
        F.count_if(status < 400).alias("succeeded"),
        F.count_if(status.between(400, 499)).alias("client_errors"),
        F.count_if(status >= 500).alias("server_errors"),
        F.avg("ms").alias("avg_ms"),
        F.max("ms").alias("max_ms"),
        F.percentile_approx("ms", F.lit(0.95), F.lit(10_000)).alias("p95_ms"),
    )

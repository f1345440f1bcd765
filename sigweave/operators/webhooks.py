"""Matching change events to subscriptions, and the health of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigweave.session import shared_dir

# What subscribers call the events.
EVENT_NAMES = {
    "added": "tech_added", "removed": "tech_removed", "confidence_change": "confidence_change",
}
ANY_DOMAIN = "*"


#: Events of one name and scope that meet the subscriptions in one group.
EVENTS_PER_SALT = 50_000
#: Deliveries that one such group makes, about.
PAIRS_PER_CELL = 500_000


def outbox(
    events: DataFrame, subscriptions: DataFrame, per_salt: int = EVENTS_PER_SALT, per_cell: int = PAIRS_PER_CELL
) -> DataFrame:
    """One row per event and active subscription that wants it, with its JSON payload.

    A subscription with a list of domains waits under each of them, one without under ``*``; an
    event looks under both.  There are few event names and one domain may have most events, so the
    events and the subscriptions under each (name, scope) are counted.  Many events are split into
    salts, and many subscriptions into parts, so that a salt and a part make ``per_cell`` deliveries
    at most, about; events are repeated per part and subscriptions per salt.  The subscriptions are
    dealt by these cells even if Spark sends the events to them, as few bytes of subscriptions may
    make many deliveries.  Scopes without events drop out before the fan-out.
    """
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    wanted = (
        subscriptions.filter("is_active")
        .select(
            F.col("id").alias("subscription_id"),
            F.col("url").alias("target"),
            F.explode(F.array_distinct("events")).alias("event"),
            F.coalesce(F.array_distinct("domains"), F.array(F.lit(ANY_DOMAIN))).alias("scopes"),
        )
        .select("subscription_id", "target", "event", F.explode("scopes").alias("scope"))
    )
    named = events.select(
        names[F.col("event_type")].alias("event"),
        "domain", "source", "canonical", "category",
        F.coalesce("new_confidence", "old_confidence").alias("confidence"),
        "detected_at",
    )
    scopes = F.explode(F.array(F.col("domain"), F.lit(ANY_DOMAIN))).alias("scope")
    # One row a map task and key is shuffled for the counts, whatever the skew.
    fired_at = named.select("event", scopes).groupBy("event", "scope").agg(F.count(F.lit(1)).alias("fired"))
    waiting_at = wanted.groupBy("event", "scope").agg(F.count(F.lit(1)).alias("waiting"))
    cells = fired_at.join(waiting_at, ["event", "scope"]).select(
        "event", "scope",
        F.ceil(F.col("fired") / per_salt).cast("int").alias("salts"),
        F.ceil(F.col("waiting") * F.least("fired", F.lit(per_salt)) / per_cell).cast("int").alias("parts"),
    )
    cell = ["event", "scope", "salt", "part"]
    waiting = (
        wanted.join(cells, ["event", "scope"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("subscription_id", "target"), F.col("parts")).cast("int"))
        .drop("salts", "parts")
        .repartition(*cell)
    )
    # The payload is the same for every subscriber, so it is written once, before the fan-out.
    fired = named.select(
        "*",
        F.to_json(
            F.struct("event", "domain", "canonical", "category", "confidence", "detected_at")
        ).alias("payload"),
    ).select("*", scopes).join(cells, ["event", "scope"])
    salt = F.pmod(F.xxhash64("domain", "source", "canonical"), F.col("salts")).cast("int")
    fired = fired.withColumn("salt", salt).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return fired.join(waiting, cell).select(
        "subscription_id", "target", "event", "domain", "source", "canonical", "category",
        "confidence", "detected_at", "payload",
    )


def delivery_health(log: DataFrame) -> DataFrame:
    """Failures since the last success, and the time of that success, per subscription.

    Two folds over the log, both combined inside the map tasks: the last success, then the failures
    after it.  The first result, one row a subscription, is written to the shared folder, so Spark
    knows its size when it picks the join: a small one is sent to the log, and no row of the log is
    shuffled.  A larger one is joined on the subscription, failures only.
    """
    spark = log.sparkSession
    path = shared_dir(spark, "delivery-health")
    fired = log.groupBy("subscription_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_fired_at"))
    fired.write.parquet(path)
    fired = spark.read.schema(fired.schema).parquet(path)
    of = fired.select(F.col("subscription_id").alias("of"), F.col("last_fired_at").alias("since"))
    failed = (
        log.filter(~F.col("ok")).select("subscription_id", "ts")
        .join(of, F.col("subscription_id").eqNullSafe(F.col("of")))
        .filter(F.col("since").isNull() | (F.col("ts") > F.col("since")))
        .select("subscription_id", F.col("since").alias("last_fired_at"), F.lit(1).alias("failed"))
    )
    return fired.withColumn("failed", F.lit(0)).unionByName(failed).groupBy("subscription_id").agg(
        F.max("last_fired_at").alias("last_fired_at"), F.sum("failed").alias("failure_count")
    )

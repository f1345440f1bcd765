"""Plan state folded from billing events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

# Requests per minute and per month of each plan, and the names of the events.
PLAN_LIMITS = {
    "starter": (60, 1_000),
    "pro": (300, 10_000),
    "enterprise": (1_000, 999_999_999),
}
COMPLETED = "checkout.session.completed"
UPDATED = "customer.subscription.updated"
DELETED = "customer.subscription.deleted"
BASE_PLAN = "starter"


def plan_state(
    keys: DataFrame, events: DataFrame, limits: Mapping[str, tuple[int, int]] = PLAN_LIMITS
) -> DataFrame:
    """Keys with the plan, limits, customer and subscription that the events leave them with.

    A completed checkout sets everything; an update sets the plan only while active; a deletion
    falls back to the base plan and clears the subscription.  Other events, unknown plans and
    events without a key change nothing.  ``events`` has seq, which orders a key's events; each
    attribute is the value at its own newest event, so one aggregation with a map-side half does.
    """
    kind, plan = F.col("type"), F.col("plan")
    known = plan.isin(*limits)
    completed = (kind == COMPLETED) & known
    deleted = kind == DELETED
    sets_plan = completed | ((kind == UPDATED) & known & (F.col("status") == "active")) | deleted
    folded = events.filter(F.col("key_id").isNotNull()).groupBy("key_id").agg(
        F.max_by(
            F.when(deleted, BASE_PLAN).otherwise(plan), F.when(sets_plan, F.col("seq"))
        ).alias("new_plan"),
        F.max_by("customer", F.when(completed, F.col("seq"))).alias("new_customer"),
        F.max_by(
            F.when(completed, F.col("subscription")), F.when(completed | deleted, F.col("seq"))
        ).alias("new_subscription"),
        F.coalesce(F.bool_or(completed), F.lit(False)).alias("has_customer"),
        F.coalesce(F.bool_or(completed | deleted), F.lit(False)).alias("has_subscription"),
    )
    table = {
        name: F.create_map(*[x for p, v in limits.items() for x in (F.lit(p), F.lit(v[i]))])
        for i, name in enumerate(("requests_per_minute", "monthly_limit"))
    }
    changed = F.col("new_plan").isNotNull()

    def limit(name: str):
        return F.when(changed, table[name][F.col("new_plan")]).otherwise(F.col(name)).alias(name)

    return keys.join(folded, "key_id", "left").select(
        "key_id",
        F.coalesce("new_plan", F.col("plan")).alias("plan"),
        limit("requests_per_minute"),
        limit("monthly_limit"),
        F.when(F.col("has_customer"), F.col("new_customer"))
        .otherwise(F.col("customer")).alias("customer"),
        F.when(F.col("has_subscription"), F.col("new_subscription"))
        .otherwise(F.col("subscription")).alias("subscription"),
    )

"""Webhook deliveries as a stream: change events land, rows of the outbox leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sigweave import schemas
from sigweave.operators.webhooks import outbox
from sigweave.streaming.changes import MAX_BATCH_BYTES


def start_outbox_stream(
    spark: SparkSession, events_path: str, subscriptions: Callable[[], DataFrame], out: str, checkpoint: str,
    max_bytes: int = MAX_BATCH_BYTES, trigger: dict | None = None,
) -> StreamingQuery:
    """Match the events that land with the subscriptions of that moment.

    ``subscriptions`` is asked once a micro-batch, so a new subscription takes effect without a
    restart.  A micro-batch, bounded by ``max_bytes``, is written to a folder named after it: if it is
    run again after a failure it replaces what it wrote, so every delivery is there once.  By default
    what has landed is processed and the query ends.  Rows without an event, with which a change
    stream takes a moment's events back, deliver nothing.
    """
    events = (
        spark.readStream.schema(schemas.CHANGE_EVENT)
        .option("maxBytesPerTrigger", max_bytes)
        .parquet(events_path)
    )

    def deliver(batch: DataFrame, batch_id: int) -> None:
        told = batch.filter(F.col("event_type").isNotNull())
        outbox(told, subscriptions()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

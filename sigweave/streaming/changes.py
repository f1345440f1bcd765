"""Change events as a stream: profile snapshots arrive in any order, events leave.

The recent versions of the profile of each (domain, source) are keyed state, so a micro-batch costs what it
brings, not what has been stored.  For a large number of keys run it on the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from sigweave import schemas

MAX_BATCH_BYTES = 2 << 30

#: How far behind the newest snapshot of its profile a late one may be.
HORIZON = timedelta(days=365)

STREAMED = f"{schemas.CHANGE_EVENT}, revision bigint"
_FIELDS = [part.split()[0] for part in STREAMED.split(", ")]

# The versions of a profile within the horizon, oldest first, one list entry each.
STATE = (
    "revision bigint, floor bigint, at array<bigint>, names array<array<string>>,"
    " categories array<array<string>>, confidences array<array<double>>"
)


def read_snapshots(spark: SparkSession, path: str, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Snapshot files as a stream.

    ``max_bytes`` bounds a micro-batch, and so what one key can bring to one task.
    """
    return (
        spark.readStream.schema(schemas.SNAPSHOT)
        .option("maxBytesPerTrigger", max_bytes)
        .parquet(path)
    )


def _between(before: dict, after: dict, confidence_changes: bool) -> Iterator[tuple]:
    """(event, technology, category, old and new confidence) from one version of a profile to the next."""
    for name, (category, confidence) in after.items():
        if name not in before:
            yield "added", name, category, None, confidence
        elif confidence_changes and before[name][1] != confidence:
            yield "confidence_change", name, category, before[name][1], confidence
    for name, (category, confidence) in before.items():
        if name not in after:
            yield "removed", name, category, confidence, None


def _load(state) -> tuple[int, int | None, dict[int, tuple]]:
    if not state.exists:
        return 0, None, {}
    revision, floor, at, names, categories, confidences = state.get
    profiles = [tuple(zip(*x)) for x in zip(names, categories, confidences)]
    return revision, floor, dict(zip(at, profiles))


def _save(state, revision: int, floor: int | None, versions: dict[int, tuple]) -> None:
    at = sorted(versions)
    columns = [[[entry[k] for entry in versions[t]] for t in at] for k in range(3)]
    state.update((revision, floor, at, *columns))


def _diff(
    key, batches: Iterable[pd.DataFrame], state, horizon: int, confidence_changes: bool
) -> Iterator[pd.DataFrame]:
    """Put the snapshots of a micro-batch into their places in time, and tell anew what that changes."""
    revision, floor, versions = _load(state)
    known, changed = set(versions), set()
    for batch in batches:
        for at, names, categories, confidences in zip(*(batch[c] for c in ("at", "names", "categories", "confidences"))):
            profile = tuple(zip(names, categories, map(float, confidences)))
            if not profile or (floor is not None and at < floor):
                continue
            # Of two snapshots of one moment the larger counts, whichever came first.
            if at not in versions or sorted(map(repr, profile)) > sorted(map(repr, versions[at])):
                versions[at] = profile
                changed.add(at)
    times = sorted(versions)
    events = []
    for i, at in enumerate(times):
        if at == floor or not (at in changed or (i and times[i - 1] in changed)):
            continue
        before, after = (
            {name: (category, confidence) for name, category, confidence in (versions[t] if t is not None else ())}
            for t in (times[i - 1] if i else None, at)
        )
        found = list(_between(before, after, confidence_changes))
        if not found and at in known:
            found = [(None, None, None, None, None)]
        events += [(*key, *event, pd.Timestamp(at, unit="us"), revision + 1) for event in found]
    # What lies further back than the horizon is only needed as the state before it.
    while len(times) > 1 and times[1] <= times[-1] - horizon:
        del versions[times.pop(0)]
        floor = times[0]
    _save(state, revision + 1, floor, versions)
    yield pd.DataFrame(events, columns=_FIELDS)


def change_stream(
    snapshots: DataFrame, horizon: timedelta = HORIZON, confidence_changes: bool = False
) -> DataFrame:
    """Events of a snapshot stream, each with a ``revision``; ``detected_at`` is the scrape time.

    Snapshots are ordered by scrape time, not by arrival.  One that arrives late is put between its
    neighbours, and the events of its moment and of the next one are told anew under a higher revision;
    a row without ``event_type`` says that a moment has none any more.  ``settled`` keeps the last word,
    which is the same however the input is split into files and batches, as long as nothing is later
    than ``horizon`` behind the newest snapshot of its profile; such snapshots are dropped.  Empty
    snapshots change nothing.
    """
    flat = snapshots.select(
        "domain", "source", F.unix_micros("scraped_at").alias("at"),
        F.transform("tech_profile", lambda t: t["canonical"]).alias("names"),
        F.transform("tech_profile", lambda t: t["category"]).alias("categories"),
        F.transform("tech_profile", lambda t: t["confidence"]).alias("confidences"),
    )
    reach = int(horizon.total_seconds() * 1_000_000)

    def diff(key, batches, state):
        return _diff(key, batches, state, reach, confidence_changes)

    return flat.groupBy("domain", "source").applyInPandasWithState(diff, STREAMED, STATE, "append", "NoTimeout")


def settled(events: DataFrame) -> DataFrame:
    """The last word on every moment of every profile, from the rows the stream has written."""
    moment = Window.partitionBy("domain", "source", "detected_at")
    last = events.withColumn("_last", F.max("revision").over(moment)).filter("revision = _last AND event_type IS NOT NULL")
    return last.drop("_last", "revision")


def start_change_stream(
    spark: SparkSession, snapshots_path: str, events_path: str, checkpoint: str,
    max_bytes: int = MAX_BATCH_BYTES, horizon: timedelta = HORIZON, confidence_changes: bool = False,
) -> StreamingQuery:
    """Process what has landed and stop; the file sink and the checkpoint make it exactly once."""
    return (
        change_stream(read_snapshots(spark, snapshots_path, max_bytes), horizon, confidence_changes)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(events_path)
    )


# Tasks may run where this package is not installed; ship the code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

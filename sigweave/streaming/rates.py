"""Rate-limit windows as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sigweave import schemas
from sigweave.operators.usage import over_limit


def read_requests(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.REQUEST_LOG)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def rate_stream(log: DataFrame, keys: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Windows over the limit, each emitted once it can no longer change.

    Requests later than ``lateness`` behind the newest one are dropped.
    """
    counts = (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 minute").alias("w"), "key_id")
        .agg(F.count("*").alias("requests"))
    )
    return over_limit(counts, keys)


def start_rate_stream(
    spark: SparkSession, log_path: str, keys: DataFrame, out: str, checkpoint: str,
    lateness: str = "10 minutes", max_files: int = 1_000,
) -> StreamingQuery:
    return (
        rate_stream(read_requests(spark, log_path, max_files), keys, lateness)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )

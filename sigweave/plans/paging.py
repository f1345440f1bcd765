"""Pages of an ordered result, and the totals that go with them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigweave.session import ensure_checkpoint_dir

# Up to here a page is a top-n; beyond it the result is sorted by range partitions.
TOP_N_ROWS = 10_000


class Page(NamedTuple):
    data: DataFrame
    pagination: DataFrame


def page_rows(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """Rows of one page.  ``order`` must be a total order."""
    if page * per_page <= TOP_N_ROWS:
        return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return deep_page_rows(df, order, page, per_page)


def deep_page_rows(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """Rows of a page far down, without gathering the rows before it.

    The result is range-partitioned and sorted, and checkpointed so that partition numbers hold.
    Partition sizes (one row a partition) give each partition's first rank, and only partitions
    that overlap the page contribute rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    first = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", first.alias("_start"))
    low = (page - 1) * per_page
    return (
        placed.join(starts, "_part")
        .withColumn("_rank", F.col("_start") + F.col("_at"))
        .filter(F.col("_rank").between(low, low + per_page - 1))
        .orderBy("_rank")
        .drop("_part", "_at", "_start", "_rank")
    )


def pagination(counted: DataFrame, page: int, per_page: int) -> DataFrame:
    """Page totals of a one-row frame with ``total``."""
    total = F.col("total")
    return counted.select(
        F.lit(page).cast("bigint").alias("page"),
        F.lit(per_page).cast("bigint").alias("per_page"),
        total,
        F.ceil(total / per_page).cast("bigint").alias("total_pages"),
        (F.lit(page * per_page) < total).alias("has_next"),
    )

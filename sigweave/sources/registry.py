"""The company registry: filtering, de-duplication and the worklist of a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The boards that take part in a refresh, in scheduling order, and the header source.
BOARDS = ("greenhouse", "lever")
HEADER_SOURCE = "html_headers"


def registry_filter(
    registry: DataFrame, board: str | None = None, domain: str | None = None
) -> DataFrame:
    """Registry rows of one board and/or one domain; both predicates reach a Parquet scan."""
    if board:
        registry = registry.filter(F.col("board") == board)
    if domain:
        registry = registry.filter(F.col("domain") == domain)
    return registry


def dedupe_by(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in an explicit order.

    Spark keeps only one row per key and map task before the shuffle, so a hot key is harmless.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def worklist(registry: DataFrame) -> DataFrame:
    """One task per registry row and board, and one header task per domain."""
    board_rank = F.array_position(F.array(*[F.lit(b) for b in BOARDS]), F.col("board"))
    known = registry.filter(F.col("board").isin(*BOARDS))
    job_tasks = known.select(
        F.concat_ws(":", "board", "domain").alias("task"),
        F.col("board").alias("source"),
        "domain", "company_name", "token",
    )
    header_tasks = dedupe_by(
        known.select("domain", "company_name", "ord", board_rank.alias("board_rank")),
        "domain", "board_rank", "ord",
    ).select(
        F.concat_ws(":", F.lit(HEADER_SOURCE), "domain").alias("task"),
        F.lit(HEADER_SOURCE).alias("source"),
        "domain", "company_name", F.lit(None).cast("string").alias("token"),
    )
    return job_tasks.unionByName(header_tasks)

"""Statistics of refresh runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def run_summary(tasks: DataFrame) -> DataFrame:
    """Attempted, succeeded, skipped and failed tasks per run type, with first and last time.

    ``tasks`` has run_type, company, status (ok, skip, fail), error, started_at, completed_at.
    """
    status = F.col("status")
    return tasks.groupBy("run_type").agg(
        F.count("*").alias("attempted"),
        F.count_if(status == "ok").alias("succeeded"),
        F.count_if(status == "skip").alias("skipped"),
        F.count_if(status == "fail").alias("failed"),
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
    )


def error_log(tasks: DataFrame) -> DataFrame:
    """The errors of the runs, one row each: a list per run type would have no bound."""
    return tasks.filter("status = 'fail'").select("run_type", "company", "error", "completed_at")

"""Reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.session import shared_dir

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the folder all executors share, and read back.

    What follows depends on these files only, so a lost executor costs its own tasks and no more.
    """
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def added(docs: DataFrame, *new: str) -> list[Column]:
    """The input's columns without those that the results named ``new`` replace."""
    return [F.col(f"`{c}`") for c in docs.columns if c not in new]

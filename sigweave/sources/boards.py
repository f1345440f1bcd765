"""Job-board payloads to normalised postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigweave import schemas
from sigweave.functions.text import null_if_empty, or_empty, strip_html

# The boards' public addresses, used where a posting carries none.
BOARD_A_JOB_URL = "https://boards.greenhouse.io/{token}/jobs/{id}"
BOARD_B_JOB_URL = "https://jobs.lever.co/{slug}/{id}"


def read_board_a(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses of board A, one JSON object a line, wrapped with their company."""
    return spark.read.schema(schemas.PAYLOAD_A).json(path)


def read_board_b(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses of board B, one JSON object a line, wrapped with their company."""
    return spark.read.schema(schemas.PAYLOAD_B).json(path)


def read_board_b_raw(spark: SparkSession, path: str) -> DataFrame:
    """Untouched responses of board B: each file is an array, each element a row."""
    return (
        spark.read.schema(schemas.POSTING_B)
        .option("multiLine", "true")
        .json(path)
        .withColumn("file", F.input_file_name())
    )


def _fill(template: str, **parts: Column) -> Column:
    """A URL template as an expression."""
    pieces: list[Column] = []
    rest = template
    for name, value in parts.items():
        before, rest = rest.split("{" + name + "}")
        pieces += [F.lit(before), value]
    return F.concat(*pieces, F.lit(rest))


def postings_a(payloads: DataFrame) -> DataFrame:
    """Postings of board A; a payload without a ``jobs`` array gives none."""
    jobs = payloads.select(
        "domain", "company_name", "token", "scraped_at",
        F.posexplode_outer("jobs").alias("pos", "j"),
    ).filter(F.col("pos").isNotNull())
    job_id = F.col("j.id").cast("string")
    return jobs.select(
        "domain",
        F.lit("greenhouse").alias("source"),
        "company_name",
        "scraped_at",
        F.col("pos").cast("bigint").alias("pos"),
        job_id.alias("posting_id"),
        or_empty(F.col("j.title")).alias("title"),
        strip_html(or_empty(F.col("j.content"))).alias("description"),
        or_empty(F.col("j.location.name")).alias("location"),
        or_empty(F.get(F.col("j.departments"), F.lit(0))["name"]).alias("department"),
        F.lit("").alias("team"),
        F.coalesce(
            null_if_empty(F.col("j.absolute_url")),
            _fill(BOARD_A_JOB_URL, token=F.col("token"), id=job_id),
        ).alias("url"),
        F.try_to_timestamp(null_if_empty(F.col("j.updated_at"))).alias("posted_at"),
    )


def _list_parts(lists: Column) -> Column:
    """For each list its heading, then its content without markup; missing parts are left out."""
    return F.flatten(
        F.transform(
            lists,
            lambda x: F.array_compact(
                F.array(
                    null_if_empty(x["text"]),
                    F.when(x["content"] != "", strip_html(x["content"], "short")),
                )
            ),
        )
    )


def postings_b(payloads: DataFrame) -> DataFrame:
    """Postings of board B; a payload that is not an array gives none."""
    rows = payloads.select(
        "domain", "company_name", "slug", "scraped_at",
        F.posexplode_outer("postings").alias("pos", "j"),
    ).filter(F.col("pos").isNotNull())
    parts = F.concat(
        F.filter(F.array("j.descriptionPlain", "j.additionalPlain"), lambda p: p != ""),
        F.coalesce(_list_parts(F.col("j.lists")), F.array().cast("array<string>")),
    )
    created = F.col("j.createdAt")
    return rows.select(
        "domain",
        F.lit("lever").alias("source"),
        "company_name",
        "scraped_at",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("j.id").alias("posting_id"),
        or_empty(F.col("j.text")).alias("title"),
        F.array_join(parts, " ").alias("description"),
        or_empty(F.col("j.categories.location")).alias("location"),
        or_empty(F.col("j.categories.department")).alias("department"),
        or_empty(F.col("j.categories.team")).alias("team"),
        F.coalesce(
            null_if_empty(F.col("j.hostedUrl")),
            _fill(BOARD_B_JOB_URL, slug=F.col("slug"), id=F.col("j.id")),
        ).alias("url"),
        F.when(created != 0, F.timestamp_millis(created)).alias("posted_at"),
    )

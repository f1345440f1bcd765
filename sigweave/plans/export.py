"""Bulk export: shaping, JSON and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sigweave import params
from sigweave.functions import profiles as p
from sigweave.plans.search import matching_profiles

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def export_rows(
    snapshots: DataFrame,
    companies: DataFrame,
    domains: Sequence[str] | None = None,
    technology: str | None = None,
    category: str | None = None,
    min_confidence: float = params.MIN_CONFIDENCE,
    fields: Sequence[str] = params.DEFAULT_EXPORT_FIELDS,
    limit: int | None = None,
) -> DataFrame:
    """Newest profiles of companies, newest scrape first: all, or the first ``limit``."""
    floor = params.confidence(min_confidence)
    chosen = params.export_fields(fields)
    if domains:
        # Whole domains are kept or dropped, so this may precede the choice of the newest.
        snapshots = snapshots.filter(F.col("domain").isin(list(domains)))
    found = matching_profiles(
        snapshots, uses=[technology] if technology else [], category=category,
        min_confidence=floor,
    )
    kept = p.at_least(F.col("tech_profile"), floor)
    shaped = {
        "domain": F.col("domain"),
        "name": F.col("name"),
        "technologies": F.array_join(p.names_of(kept), ", "),
        "categories": p.names_by_category(kept),
        "last_scraped": F.col("scraped_at"),
        "job_count": F.col("job_count"),
    }
    rows = found.join(companies.select("domain", "name"), "domain").orderBy(F.desc("scraped_at"), "domain")
    return (rows if limit is None else rows.limit(limit)).select(*[shaped[f].alias(f) for f in chosen])


def write_json(rows: DataFrame, path: str, filters: dict, exported_at: Column) -> None:
    """Export rows as JSON lines under ``data`` and the envelope (time, count, filters) under ``header``."""
    rows.write.mode("overwrite").json(f"{path}/data")
    data = rows.sparkSession.read.schema(rows.schema).json(f"{path}/data")
    used = F.struct(*[F.lit(v).alias(k) for k, v in filters.items() if v is not None])
    header = data.agg(F.count("*").alias("count")).select(
        exported_at.cast("timestamp").alias("exported_at"), "count", used.alias("filters")
    )
    header.write.mode("overwrite").json(f"{path}/header")


def _as_text(df: DataFrame) -> list[Column]:
    """Every column as the text of its CSV cell; nested values become JSON."""
    cells = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, (MapType, ArrayType, StructType)):
            col = F.to_json(col)
        elif f.dataType.simpleString() == "timestamp":
            col = F.date_format(col, TIME_FORMAT)
        cells.append(col.cast("string").alias(f.name))
    return cells


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one CSV line, by the rule the sink below also follows.

    Null is empty; a value with a comma, a quote or a line break is quoted, quotes are doubled.
    """
    def cell(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(c.rlike('[,"\n]'), quoted).otherwise(c), F.lit(""))

    text = df.select(*_as_text(df))
    return text.select(F.concat_ws(",", *[cell(F.col(c)) for c in text.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header line, also for an empty result."""
    df.select(*_as_text(df)).write.mode("overwrite").options(
        header="true", quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)

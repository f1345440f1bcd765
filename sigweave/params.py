"""Bounds and defaults of query parameters; a bad value raises ``ValueError``."""

from __future__ import annotations

from collections.abc import Sequence

# Sources a caller may name, columns a list may be sorted by, export fields with
# their defaults, and the bounds and defaults of numbers.
SOURCES = ("greenhouse", "lever", "indeed", "html_headers")
SORT_COLUMNS = ("domain", "name", "updated_at")
EXPORT_FIELDS = ("domain", "name", "technologies", "categories", "last_scraped", "job_count")
DEFAULT_EXPORT_FIELDS = ("domain", "name", "technologies", "last_scraped")
MIN_CONFIDENCE = 0.6
PER_PAGE, MAX_PER_PAGE = 25, 100
MAX_TARGETS = 20
MAX_QUERY_LENGTH = 100
EXPORT_CAPS = {"pro": 100, "enterprise": 500}
REFUSED_PLAN = "starter"
MAX_SUBSCRIPTION_DOMAINS = 50


def confidence(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"min_confidence must be between 0 and 1, not {value}")
    return float(value)


def paging(page: int, per_page: int) -> tuple[int, int]:
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page must be between 1 and {MAX_PER_PAGE}")
    return page, per_page


def targets(name: str, values: Sequence[str] | None, least: int = 1) -> list[str]:
    if values is None:
        return []
    if not least <= len(values) <= MAX_TARGETS:
        raise ValueError(f"{name} takes {least} to {MAX_TARGETS} technologies")
    return list(values)


def sources(text: str | None) -> list[str]:
    """A comma-separated list cut down to known sources; an empty result means no filter."""
    return [s for s in (p.strip() for p in (text or "").split(",")) if s in SOURCES]


def sorting(column: str, order: str) -> tuple[str, bool]:
    if column not in SORT_COLUMNS:
        raise ValueError(f"sort must be one of {SORT_COLUMNS}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    return column, order == "desc"


def search_text(q: str | None) -> str | None:
    if q is not None and len(q) > MAX_QUERY_LENGTH:
        raise ValueError(f"q has at most {MAX_QUERY_LENGTH} characters")
    return q or None


def export_fields(fields: Sequence[str]) -> list[str]:
    unknown = [f for f in fields if f not in EXPORT_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; choose among {EXPORT_FIELDS}")
    return list(fields)


def export_cap(plan: str) -> int:
    """What a caller may pass as the limit of an export, to hold it to its plan."""
    if plan == REFUSED_PLAN:
        raise PermissionError(f"plan {plan!r} has no bulk export")
    return EXPORT_CAPS["enterprise" if plan == "enterprise" else "pro"]

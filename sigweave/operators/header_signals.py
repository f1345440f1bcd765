"""Technology signals from response headers and the generator tag.

The rules become one array expression over the capture row.  Matching, and picking the best signal
per technology, happen inside the row: there is no explode of headers, no join and no shuffle, and
every pattern is a constant the JVM compiles once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigweave.sources.registry import HEADER_SOURCE
from sigweave.sources.rules import GENERATOR_RULES, HEADER_RULES, GeneratorRule, HeaderRule

# Confidence and source name of each kind of signal, and the patterns of the generator tag.
HEADER_CONFIDENCE, HEADER_SIGNAL = 0.92, "http_headers"
GENERATOR_CONFIDENCE, GENERATOR_SIGNAL = 0.95, "meta_generator"
GENERATOR_PATTERNS = (
    r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']generator["']""",
)


def lower_keys(headers: str) -> Column:
    """A header map with lower-case names; the first spelling of a name wins."""
    names = f"transform(map_keys({headers}), k -> lower(k))"
    return F.expr(
        f"""
        map_from_entries(filter(
          transform(map_entries({headers}), e -> named_struct('key', lower(e.key), 'value', e.value)),
          (e, i) -> array_position({names}, e.key) = i + 1))
        """
    )


def header_rows(captures: DataFrame) -> DataFrame:
    """One row per capture and header."""
    return captures.select(
        "domain", "company_name", "scraped_at",
        F.explode(lower_keys("headers")).alias("header", "value"),
    )


def generator_value(body: Column) -> Column:
    """Content of the generator tag of a page, wherever it stands, null when there is none."""
    found = [F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in GENERATOR_PATTERNS]
    return F.coalesce(*found)


_SIGNAL = (
    "struct<rule_ord: int, canonical: string, category: string, confidence: double, source: string>"
)


def _signals(tests: Sequence[str], signals: Sequence[dict]) -> Column:
    """The signals whose test holds.  Tests are SQL over the row; the signals are one constant."""
    numbered = ", ".join(f"if({test}, {i}, null)" for i, test in enumerate(tests))
    table = F.from_json(F.lit(json.dumps(signals)), f"array<{_SIGNAL}>")
    return F.transform(F.expr(f"array_compact(array({numbered}))"), lambda i: F.get(table, i))


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def header_matches(headers: str, rules: Sequence[HeaderRule] = HEADER_RULES) -> Column:
    """Signals of every rule whose header is present, non-empty and matches, in rule order.

    ``headers`` names a map column with lower-case keys.
    """
    tests = [
        f"try_element_at({headers}, {_text(r.header)}) rlike {_text('(?i)' + r.pattern)}"
        for r in rules
    ]
    return _signals(
        tests,
        [
            dict(rule_ord=i, canonical=r.canonical, category=r.category,
                 confidence=HEADER_CONFIDENCE, source=HEADER_SIGNAL)
            for i, r in enumerate(rules)
        ],
    )


def generator_matches(
    generator: str, rules: Sequence[GeneratorRule] = GENERATOR_RULES, first_ord: int = 0
) -> Column:
    """Signals of every rule that matches the generator column, in rule order."""
    tests = [f"{generator} rlike {_text('(?i)' + r.pattern)}" for r in rules]
    return _signals(
        tests,
        [
            dict(rule_ord=first_ord + i, canonical=r.canonical, category=r.category,
                 confidence=GENERATOR_CONFIDENCE, source=GENERATOR_SIGNAL)
            for i, r in enumerate(rules)
        ],
    )


def _prepared(captures: DataFrame) -> DataFrame:
    return captures.select(
        "domain", "company_name", "scraped_at",
        lower_keys("headers").alias("_headers"),
        generator_value(F.col("body")).alias("_generator"),
    )


def header_signals(captures: DataFrame, rules: Sequence[HeaderRule] = HEADER_RULES) -> DataFrame:
    rows = _prepared(captures).select(
        "domain", "scraped_at", header_matches("_headers", rules).alias("s")
    )
    return rows.select("domain", "scraped_at", F.inline_outer("s")).filter("rule_ord is not null")


def generator_signals(
    captures: DataFrame, rules: Sequence[GeneratorRule] = GENERATOR_RULES
) -> DataFrame:
    rows = _prepared(captures).select(
        "domain", "scraped_at", "_generator",
        generator_matches("_generator", rules).alias("s"),
    )
    return rows.select(
        "domain", "scraped_at", F.col("_generator").alias("generator"), F.inline_outer("s")
    ).filter("rule_ord is not null")


# The most confident of ``_signals`` for each technology (first on a tie), placed where the
# technology first occurs.
_BEST = """
array_sort(transform(
  filter(_signals, x -> not exists(_signals, y ->
    y.canonical = x.canonical
    and (y.confidence > x.confidence or (y.confidence = x.confidence and y.rule_ord < x.rule_ord)))),
  x -> named_struct(
    'place', array_min(transform(filter(_signals, y -> y.canonical = x.canonical), y -> y.rule_ord)),
    'canonical', x.canonical, 'category', x.category, 'confidence', x.confidence,
    'source', x.source)))
"""


def header_profile(
    captures: DataFrame,
    header_rules: Sequence[HeaderRule] = HEADER_RULES,
    generator_rules: Sequence[GeneratorRule] = GENERATOR_RULES,
) -> DataFrame:
    """``profile_tech`` rows of header captures; captures without a signal give none."""
    signals = _prepared(captures).select(
        "domain", "scraped_at",
        F.concat(
            header_matches("_headers", header_rules),
            generator_matches("_generator", generator_rules, len(header_rules)),
        ).alias("_signals"),
    )
    best = signals.select("domain", "scraped_at", F.expr(_BEST).alias("_best"))
    return (
        best.select("domain", "scraped_at", F.posexplode_outer("_best").alias("_pos", "_s"))
        .filter(F.col("_pos").isNotNull())
        .select(
            "domain",
            F.lit(HEADER_SOURCE).alias("source"),
            "scraped_at",
            "_s.canonical", "_s.category", "_s.confidence",
            F.array("_s.source").alias("sources"),
            F.lit(0).alias("job_mention_count"),
            F.lit(0.0).alias("job_mention_frequency"),
            F.lit(0).alias("job_count"),
            (F.col("_pos") + 1).alias("tech_ord"),
        )
    )

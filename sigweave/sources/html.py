"""Parsers for landed HTML pages: job links, job details, pagination, and board tokens.

``pages`` has page_id, url and html.  Everything a regular expression can decide is a native
expression over the whole page; nested elements go through ``mapInArrow``, which receives the
markup only of pages that contain the wanted element.  Of a batch about a megabyte of markup at a
time is turned into Python strings, and its results leave before the next is read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from sigweave.functions.text import (
    WHITESPACE_CHARS, decode_entities, encode_component, null_if_empty, trim_all,
)
from sigweave.sources.markup import (
    Selector, any_of, attr_contains, attr_is, find, has_class, is_tag,
)

# Site address, and how many links and details are taken by default.
JOB_SITE = "https://www.indeed.com"

# How the site's search asks for one employer's jobs, newest first.
SEARCH_FILTER = "&sc=0kf%3Aattr(DSQF7)%3B&sort=date"

# Where a job page keeps its description, title and company, in order of preference.
DESCRIPTION = [
    Selector(attr_is("data-testid", "jobsearch-JobComponent-description")),
    Selector(attr_is("id", "jobDescriptionText")),
    Selector(has_class("jobsearch-jobDescriptionText")),
    Selector(attr_contains("class", "jobDescription")),
    Selector(has_class("job-description")),
]
DESCRIPTION_MARKS = ["jobsearch-JobComponent-description", "jobDescription", "job-description"]
TITLE = [
    Selector(attr_is("data-testid", "jobTitle")),
    Selector(has_class("jobsearch-JobInfoHeader-title")),
    Selector(attr_contains("class", "title", tag="h1")),
    Selector(is_tag("h1")),
]
COMPANY = Selector(
    any_of(
        attr_is("data-testid", "inlineHeader-companyName"),
        has_class("jobsearch-InlineCompanyRating-companyHeader"),
    )
)

# Where a result page keeps job cards (second choice) and its page numbers.
CARD_LINK = Selector(
    is_tag("a"), any_of(attr_contains("class", "jobTitle"), attr_is("data-testid", "job-title"))
)
CARD_MARKS = ["jobTitle", "job-title"]


def _in_pagination(e) -> bool:
    return (e.tag == "nav" and e.attrs.get("aria-label") == "pagination") or e.attrs.get(
        "data-testid"
    ) == "pagination"


PAGE_LINK = Selector(is_tag("a"), _in_pagination)
PAGE_MARKS = ["pagination"]

_RUNS = re.compile(f"[{WHITESPACE_CHARS}]{{2,}}")


def _contains_any(col: Column, parts: list[str]) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | col.contains(part)
    return test


def tags_only(html: Column) -> Column:
    """Markup without comments and without the inside of scripts and styles."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(html, r"(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)>)", "$1$2")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag: null when absent, empty when it has no value."""
    pairs = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    pair = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?i)\A{name}\s*=")), F.lit(0))
    return decode_entities(F.regexp_replace(pair, r"""(?s)\A[^=]*=\s*["']?|["']\z""", ""), attribute=True)


def _has_attribute(tag: Column, name: str) -> Column:
    bare = F.regexp_replace(tag, r"""(?s)"[^"]*"|'[^']*'""", '""')
    return bare.rlike(rf"(?i)\s{name}[\s=/>]")


def search_address(company_name: Column, location: Column | None = None) -> Column:
    """Address of the result page for one company, optionally in one place."""
    url = F.concat(
        F.lit(f"{JOB_SITE}/jobs?q="),
        encode_component(F.concat(F.lit('"'), company_name, F.lit('"'))),
        F.lit(SEARCH_FILTER),
    )
    if location is None:
        return url
    place = F.concat(F.lit("&l="), encode_component(location))
    return F.concat(url, F.when(location != "", place).otherwise(""))


def absolute(href: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(JOB_SITE), href))


def _absolute(href: str) -> str:
    return href if href.startswith("http") else JOB_SITE + href


# An opening tag ends at the first ">" outside quotes.
_REST_OF_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?s)[^\s=>"'/<]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""

_LINK = "array<struct<url: string, title: string, jk: string>>"


def _anchor_links(html: Column) -> Column:
    """Links of anchors that carry a job key or a job id, and whose address has a ``jk``."""
    anchors = F.regexp_extract_all(
        tags_only(html), F.lit(rf"(?is)<a\b{_REST_OF_TAG}.*?</a\s*>"), F.lit(0)
    )
    parsed = F.transform(
        anchors,
        lambda a: F.struct(
            F.regexp_extract(a, rf"(?is)\A(<a\b{_REST_OF_TAG})", 1).alias("tag"),
            trim_all(
                decode_entities(F.regexp_replace(a, rf"(?is)</?[a-z]{_REST_OF_TAG}", ""))
            ).alias("title"),
        ),
    )
    cards = F.filter(
        parsed,
        lambda p: _has_attribute(p["tag"], "data-jk")
        | F.coalesce(attribute(p["tag"], "id").startswith("job_"), F.lit(False)),
    )
    # Each step binds what the next one uses more than once, so nothing is parsed twice.
    addressed = F.transform(
        cards, lambda p: F.struct(attribute(p["tag"], "href").alias("href"), p["title"])
    )
    links = F.transform(
        F.filter(addressed, lambda x: (x["href"] != "") & (x["title"] != "")),
        lambda x: F.struct(
            absolute(x["href"]).alias("url"),
            x["title"].alias("title"),
            F.regexp_extract(x["href"], r"(?i)[?&]jk=([a-z0-9]+)", 1).alias("jk"),
        ),
    )
    return F.filter(links, lambda x: x["jk"] != "")


def _card_links(html: str) -> list[dict]:
    links = []
    for a in find(html, CARD_LINK)[0]:
        href, title = a.attrs.get("href"), a.content().strip(WHITESPACE_CHARS)
        if href and title:
            links.append({"url": _absolute(href), "title": title, "jk": None})
    return links


#: Bytes of markup that are Python strings at one time, about; a longer page is a portion of its own.
PORTION = 1 << 20


def _portions(batches: Iterator[pa.RecordBatch], markup: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``markup`` makes about ``PORTION`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(markup)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        nth = (np.cumsum(size) - size) // PORTION
        at = np.r_[np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]]), len(nth)]
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield batch.slice(begin, end - begin)


def _fill_from_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _portions(batches, "rest"):
        rest, links = part.column("rest"), part.column("links")
        if rest.null_count < len(rest):
            found = pa.array([None if h is None else _card_links(h) for h in rest.to_pylist()], links.type)
            links = pc.if_else(rest.is_valid(), found, links)
        yield pa.RecordBatch.from_arrays([part.column("page_id"), links], names=["page_id", "links"])


def job_links(pages: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Job links of result pages with their position: all, or the first ``max_jobs`` of each page.

    Pages without a keyed anchor fall back to the links inside job-title elements; only their
    markup goes to Python.
    """
    primary = pages.select("page_id", "html", _anchor_links(F.col("html")).alias("links"))
    with_rest = primary.select(
        "page_id",
        "links",
        F.when((F.size("links") == 0) & _contains_any(F.col("html"), CARD_MARKS), F.col("html"))
        .alias("rest"),
    )
    filled = with_rest.mapInArrow(
        _fill_from_cards, f"{_id_type(pages)}, links {_LINK}"
    )
    links = F.col("links") if max_jobs is None else F.slice("links", 1, max_jobs)
    return filled.select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", "pos", "link.*")


def _id_type(pages: DataFrame) -> str:
    return f"page_id {pages.schema['page_id'].dataType.simpleString()}"


def _text(elements: list) -> str:
    return "".join(e.content() for e in elements).strip(WHITESPACE_CHARS)


def _detail(html: str) -> tuple[str, str, str]:
    """Title, description and company of one page.

    The first selector with a match counts; a description takes all its matches, the others one.
    """
    found = find(html, *DESCRIPTION, *TITLE, COMPANY)
    n, m = len(DESCRIPTION), len(DESCRIPTION) + len(TITLE)
    description = next((f for f in found[:n] if f), [])
    title = next((f for f in found[n:m] if f), [])
    return _text(title[:1]), _RUNS.sub(" ", _text(description)), _text(found[m][:1])


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _portions(batches, "html"):
        html = part.column("html")
        parsed = [_detail(h) for h in html.to_pylist()]
        kept = [i for i, p in enumerate(parsed) if p[1] != ""]
        own = part.select(["page_id", "url"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*own.columns, *[pa.array([parsed[i][k] for i in kept], html.type) for k in range(3)]],
            names=["page_id", "url", "title", "description", "company"],
        )


def job_details(pages: DataFrame) -> DataFrame:
    """Title, description and company of job pages; pages without a description are dropped."""
    candidates = pages.filter(_contains_any(F.col("html"), DESCRIPTION_MARKS)).select(
        "page_id", "url", "html"
    )
    return candidates.mapInArrow(
        _details, f"{_id_type(pages)}, url string, title string, description string, company string"
    )


def job_postings(links: DataFrame, details: DataFrame, n: int | None = None) -> DataFrame:
    """Postings of a job site: the links of a page (the first ``n`` if given) that have a detail page.

    ``details`` has one row per url.
    """
    # job_details names the page's own address "url"; a link's address is the join key.
    d = details.select(
        "url", F.col("title").alias("detail_title"), "description", F.col("company").alias("page_company")
    )
    return (
        (links if n is None else links.filter(F.col("pos") < n))
        .join(d, "url")
        .select(
            "page_id",
            F.lit("indeed").alias("source"),
            F.col("pos").cast("bigint").alias("pos"),
            F.coalesce("jk", "url").alias("posting_id"),
            F.coalesce(null_if_empty(F.col("detail_title")), F.col("title")).alias("title"),
            "description",
            "url",
        )
    )


def _page_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _portions(batches, "html"):
        html, rows = part.column("html"), []
        for i, page in enumerate(html.to_pylist()):
            for a in find(page, PAGE_LINK)[0]:
                href, text = a.attrs.get("href"), a.content().strip(WHITESPACE_CHARS)
                if href and re.fullmatch("[0-9]+", text):
                    rows.append((i, int(text), _absolute(href)))
        at, page, url = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id").take(pa.array(at, pa.int64())), pa.array(page, pa.int32()), pa.array(url, html.type)],
            names=["page_id", "page", "url"],
        )


def pagination(pages: DataFrame) -> DataFrame:
    """Numbered links inside the pagination element of result pages."""
    candidates = pages.filter(_contains_any(F.col("html"), PAGE_MARKS)).select("page_id", "html")
    return candidates.mapInArrow(_page_numbers, f"{_id_type(pages)}, page int, url string")


# How a careers page points at its job board.
TOKEN_A_TAG = r"(?i)greenhouse\.io/(?:embed/job_board\?for=|jobs/)([a-z0-9_-]+)"
TOKEN_A_ANYWHERE = r"(?i)greenhouse\.io/(?:embed/job_board\?for=|boards/)([a-z0-9_-]+)"
TOKEN_B = r"(?i)jobs\.lever\.co/([a-z0-9_-]+)"
BOARD_A_HOST = "greenhouse.io"


def _token_a(html: Column) -> Column:
    tags = F.regexp_extract_all(
        tags_only(html), F.lit(rf"(?is)<(?:script|iframe|a)\b{_REST_OF_TAG}"), F.lit(0)
    )
    # Each step binds what the next one uses more than once, so nothing is parsed twice.
    parsed = F.transform(
        tags,
        lambda t: F.struct(
            t.rlike(r"(?i)\A<a\b").alias("anchor"),
            attribute(t, "src").alias("src"),
            attribute(t, "href").alias("href"),
        ),
    )
    pointing = F.filter(
        parsed, lambda p: F.when(p["anchor"], p["href"]).otherwise(p["src"]).contains(BOARD_A_HOST)
    )
    tokens = F.transform(
        pointing,
        lambda p: F.regexp_extract(
            F.coalesce(null_if_empty(p["src"]), p["href"]), TOKEN_A_TAG, 1
        ),
    )
    return F.coalesce(
        F.try_element_at(F.filter(tokens, lambda x: x != ""), F.lit(-1)),
        null_if_empty(F.regexp_extract(html, TOKEN_A_ANYWHERE, 1)),
    )


def discover_tokens(pages: DataFrame, board: str) -> DataFrame:
    """Board tokens found on careers pages; pages without one are dropped.

    Board A takes the last script, frame or link that points at the board, else the first mention
    anywhere; board B takes the first mention.
    """
    html = F.col("html")
    if board == "greenhouse":
        mentioned, token = html.rlike(r"(?i)greenhouse\.io/"), _token_a(html)
    elif board == "lever":
        mentioned, token = html.rlike(TOKEN_B), F.regexp_extract(html, TOKEN_B, 1)
    else:
        raise ValueError(f"unknown board {board!r}")
    # Through a generator, so that the test for a missing token does not search the page again.
    found = pages.filter(mentioned).select(
        "page_id", "url", F.explode_outer(F.array(token)).alias("token")
    )
    return found.filter(F.col("token").isNotNull())


# Tasks may run where this package is not installed; ship the code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

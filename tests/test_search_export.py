import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from sigweave import params
from sigweave.plans import company, export, paging, report, search
from sigweave.schemas import SNAPSHOT

STACK = [("React", "frontend", 0.92), ("TypeScript", "language", 0.88), ("Go", "language", 0.75), ("PostgreSQL", "database", 0.7)]


def profile(*techs):
    return [(n, c, x, ["job_listing"], 1, 0.5) for n, c, x in techs]


@pytest.fixture(scope="module")
def data(spark):
    from conftest import at

    rows = [
        ("stripe.com", "greenhouse", at(5), 42, 4, profile(*STACK)),
        ("stripe.com", "lever", at(1), 1, 1, profile(("Angular", "frontend", 0.9))),
        ("b.com", "lever", at(4), 2, 2, profile(("React", "frontend", 0.5), ("Go", "language", 0.9))),
        ("c.com", "lever", at(3), 3, 1, profile(("Angular", "frontend", 0.7))),
        ("lost.com", "lever", at(6), 1, 1, profile(("React", "frontend", 0.9))),
        ("empty.com", "lever", at(6), 0, 0, []),
    ]
    companies = [("stripe.com", "Stripe", at(1), at(3)), ("b.com", "B_X, \"Inc\"", at(1), None),
                 ("c.com", "See", at(1), at(2)), ("empty.com", "Empty", at(1), at(2)), ("none.com", "None", at(1), at(9))]
    return (
        spark.createDataFrame(rows, SNAPSHOT),
        spark.createDataFrame(companies, "domain string, name string, created_at timestamp, updated_at timestamp"),
    )


def domains(page):
    return [r.domain for r in page.data.collect()]


def test_search(data):
    snaps, comps = data
    assert domains(search.search_stack(snaps, comps, uses=["React"])) == ["stripe.com"]
    assert domains(search.search_stack(snaps, comps, uses=["React", "Go"], min_confidence=0.5)) == ["stripe.com", "b.com"]
    assert domains(search.search_stack(snaps, comps, uses_any=["React", "Angular"])) == ["stripe.com", "c.com"]
    # Exclusion ignores confidence; the older Angular profile of stripe.com does not count.
    assert domains(search.search_stack(snaps, comps, uses=["Go"], excludes=["React"])) == []
    assert domains(search.search_stack(snaps, comps, uses_any=["Go"], excludes=["Angular"])) == ["stripe.com", "b.com"]
    assert domains(search.search_stack(snaps, comps, uses=["Go"], category="database")) == ["stripe.com"]
    row = search.search_stack(snaps, comps, uses=["Go"], uses_any=["React", "Go"]).data.collect()[0]
    assert [t.canonical for t in row.matched_technologies] == ["React", "Go"]


def test_search_arguments(data):
    snaps, comps = data
    for bad in ({}, {"uses": []}, {"uses": ["x"] * 21}, {"uses": ["x"], "min_confidence": 1.5},
                {"uses": ["x"], "page": 0}, {"uses": ["x"], "per_page": 101}):
        with pytest.raises(ValueError):
            search.search_stack(snaps, comps, **bad)
    for call in (lambda: params.sorting("id", "asc"), lambda: params.sorting("name", "up"),
                 lambda: params.search_text("x" * 101), lambda: params.export_fields(["secret"])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(PermissionError):
        params.export_cap("starter")
    assert (params.export_cap("pro"), params.export_cap("enterprise"), params.export_cap("other")) == (100, 500, 100)
    assert params.sources(" lever, bogus ,html_headers") == ["lever", "html_headers"]
    assert params.sources("bogus") == []


def test_pagination_totals(data):
    snaps, comps = data
    got = search.search_stack(snaps, comps, uses_any=["React", "Angular"], per_page=1, page=2)
    # The total counts profiles, also those without a company.
    assert tuple(got.pagination.collect()[0]) == (2, 1, 3, 3, True)
    assert domains(got) == ["c.com"]


def test_company_list(data):
    snaps, comps = data
    rows = search.company_list(comps, snaps).data.collect()
    assert [(r.domain, r.source_count) for r in rows] == [
        ("b.com", 1), ("none.com", 0), ("stripe.com", 2), ("c.com", 1), ("empty.com", 1)]
    assert domains(search.company_list(comps, snaps, sort="name", order="asc", per_page=2)) == ["b.com", "empty.com"]
    # Wildcards in the query stay wildcards.
    assert domains(search.company_list(comps, snaps, q="B_X")) == ["b.com"]
    assert domains(search.company_list(comps, snaps, q="s%e.COM")) == ["stripe.com"]


def test_company_detail(data, spark):
    snaps, comps = data
    rows = {r.domain: r for r in company.company_detail(comps, snaps, sources="greenhouse,x").collect()}
    assert [t.canonical for t in rows["stripe.com"].technologies] == ["React", "TypeScript", "Go", "PostgreSQL"]
    rows = {r.domain: r for r in company.company_detail(comps, snaps, category="language").collect()}
    assert [t.canonical for t in rows["stripe.com"].technologies] == ["TypeScript", "Go"]
    assert rows["stripe.com"].sources_available == ["greenhouse", "lever"]
    assert (rows["empty.com"].tech_count, rows["empty.com"].sources_available) == (0, ["lever"])
    assert "none.com" not in rows and "lost.com" not in rows
    rows = {r.domain: r for r in company.company_detail(comps, snaps, min_confidence=0.85).collect()}
    assert [t.canonical for t in rows["stripe.com"].technologies] == ["React", "Angular", "TypeScript"]
    assert set(rows["stripe.com"].by_category) == {"frontend", "language"}
    assert rows["c.com"].technologies == []


def test_pages_join_up_to_the_whole(spark):
    df = spark.range(137).select((F.col("id") % 10).alias("g"), F.col("id").alias("n"))
    order = [F.desc("g"), F.col("n")]
    whole = df.orderBy(*order).collect()
    for rows in (paging.page_rows, paging.deep_page_rows):
        got = [r for page in range(1, 5) for r in rows(df, order, page, 40).collect()]
        assert got == whole


def test_deep_pages_are_taken_past_the_limit(spark, monkeypatch):
    monkeypatch.setattr(paging, "TOP_N_ROWS", 10)
    df = spark.range(50)
    got = paging.page_rows(df, [F.desc("id")], 3, 7).collect()
    assert [r.id for r in got] == [35 - i for i in range(7)]


def test_export_rows(data):
    snaps, comps = data
    rows = export.export_rows(snaps, comps, fields=params.EXPORT_FIELDS).collect()
    assert [r.domain for r in rows] == ["empty.com", "stripe.com", "b.com", "c.com"]
    stripe = rows[1]
    assert stripe.technologies == "React, TypeScript, Go, PostgreSQL"
    assert stripe.categories == {"frontend": ["React"], "language": ["TypeScript", "Go"], "database": ["PostgreSQL"]}
    assert rows[2].technologies == "Go"
    picked = export.export_rows(snaps, comps, technology="Go", domains=["b.com", "c.com"], fields=["name"])
    assert picked.columns == ["name"] and [r.name for r in picked.collect()] == ['B_X, "Inc"']
    with pytest.raises(PermissionError):
        export.export_rows(snaps, comps, limit=params.export_cap("starter"))


def read_text(path, suffix):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/*.{suffix}")))


def test_csv_sink_and_lines_agree(data, spark, tmp_path):
    snaps, comps = data
    rows = export.export_rows(snaps, comps, fields=params.EXPORT_FIELDS).coalesce(1)
    export.write_csv(rows, str(tmp_path / "csv"))
    text = read_text(tmp_path / "csv", "csv")
    lines = [r.line for r in export.csv_lines(rows).collect()]
    assert text == "\n".join([",".join(params.EXPORT_FIELDS), *lines]) + "\n"
    parsed = list(csv.reader(text.splitlines()))
    assert parsed[3][1] == 'B_X, "Inc"' and '"B_X, ""Inc"""' in text
    assert json.loads(parsed[2][3])["language"] == ["TypeScript", "Go"]


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"', None, " x ", "l1\nl2", "")], "a string, b string, c string, d string, e string").coalesce(1)
    assert export.csv_lines(df).collect()[0].line == '"a,""b""",, x ,"l1\nl2",'
    export.write_csv(df, str(tmp_path / "cells"))
    assert read_text(tmp_path / "cells", "csv") == 'a,b,c,d,e\n"a,""b""",, x ,"l1\nl2",\n'
    export.write_csv(df.limit(0), str(tmp_path / "none"))
    assert read_text(tmp_path / "none", "csv") == "a,b,c,d,e\n"


def test_json_envelope(data, spark, tmp_path):
    snaps, comps = data
    rows = export.export_rows(snaps, comps, technology="React")
    export.write_json(rows, str(tmp_path / "j"), {"technology": "React", "category": None, "min_confidence": 0.6},
                      F.lit("2024-02-01"))
    header = json.loads(read_text(tmp_path / "j" / "header", "json"))
    assert (header["count"], header["filters"]) == (1, {"technology": "React", "min_confidence": 0.6})
    assert json.loads(read_text(tmp_path / "j" / "data", "json"))["domain"] == "stripe.com"


def test_report(data, spark, tmp_path):
    snaps, comps = data
    report.write_report(snaps, comps, str(tmp_path / "r"), F.lit("2024-02-01"), F.lit("2024-02-02"))
    header = json.loads(read_text(tmp_path / "r" / "header", "json"))
    assert (header["total_companies"], header["total_jobs"]) == (6, 49)
    results = [json.loads(x) for x in read_text(tmp_path / "r" / "results", "json").splitlines()]
    stripe = next(r for r in results if r["job_count"] == 42)
    assert stripe["company_name"] == "Stripe"
    assert [t["name"] for t in stripe["top_tech"]] == ["React", "TypeScript", "Go", "PostgreSQL"]


def test_export_is_whole_unless_limited(data):
    snaps, comps = data[:2]
    whole = export.export_rows(snaps, comps).count()
    assert whole > 1 and export.export_rows(snaps, comps, limit=1).count() == 1
    many = [f"d{i}.com" for i in range(600)] + [r.domain for r in comps.collect()]
    assert export.export_rows(snaps, comps, domains=many).count() == whole


def test_a_backslash_in_the_search_text_takes_the_next_character_as_it_is(spark, t):
    companies = spark.createDataFrame(
        [(d, n, t(1), t(1)) for d, n in (("a.com", "ab"), ("b.com", "a%b"), ("c.com", "a\\b"), ("d.com", "x%"))],
        "domain string, name string, created_at timestamp, updated_at timestamp")
    none = spark.createDataFrame([], SNAPSHOT)
    found = lambda q: sorted(domains(search.company_list(companies, none, q=q)))
    assert found("a\\b") == ["a.com"] and found("a\\%b") == ["b.com"] and found("a%b") == ["a.com", "b.com", "c.com"]
    assert found("a\\\\b") == ["c.com"] and found("x\\") == ["d.com"]

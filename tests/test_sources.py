import json

import pyarrow as pa
import pytest

from sigweave.sources import boards, html, registry


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_board_a_from_landed_json(spark, tmp_path):
    job = {"id": 7, "title": None, "content": "<p>Go &amp; Rust</p>", "location": {"name": "Oslo"},
           "departments": [{"name": "Eng"}, {"name": "Ops"}], "absolute_url": None,
           "updated_at": "2024-01-15T10:00:00-05:00"}
    bare = {"id": 8, "title": "T"}
    lines = [
        {"domain": "a.com", "company_name": "A", "token": "tok", "scraped_at": "2024-01-20T00:00:00Z",
         "jobs": [job, bare]},
        {"domain": "b.com", "token": "x"},
        {"domain": "c.com", "token": "y", "jobs": []},
    ]
    path = write(tmp_path, "a.json", "\n".join(map(json.dumps, lines)))
    rows = {r.posting_id: r for r in boards.postings_a(boards.read_board_a(spark, path)).collect()}
    assert set(rows) == {"7", "8"}
    r = rows["7"]
    assert (r.title, r.description, r.location, r.department) == ("", "Go & Rust", "Oslo", "Eng")
    assert r.url == "https://boards.greenhouse.io/tok/jobs/7"
    assert str(r.posted_at) == "2024-01-15 15:00:00"
    assert (rows["8"].description, rows["8"].location, rows["8"].department, rows["8"].posted_at) == ("", "", "", None)


def test_board_b_from_landed_json(spark, tmp_path):
    posting = {
        "id": "p1", "text": "Dev", "descriptionPlain": "Plain", "additionalPlain": "",
        "lists": [{"text": "Need", "content": "<li>Go&nbsp;1</li>"}, {"text": None, "content": "<b></b>"}, {"text": "End"}],
        "categories": {"team": "Core"}, "createdAt": 1704067200000,
    }
    lines = [
        {"domain": "a.com", "slug": "s", "postings": [posting, {"id": "p2", "hostedUrl": "https://h", "createdAt": 0}]},
        {"domain": "b.com", "slug": "s"},
    ]
    path = write(tmp_path, "b.json", "\n".join(map(json.dumps, lines)))
    rows = {r.posting_id: r for r in boards.postings_b(boards.read_board_b(spark, path)).collect()}
    r = rows["p1"]
    assert r.description == "Plain Need Go 1  End"
    assert (r.team, r.location, r.url, str(r.posted_at)) == (
        "Core", "", "https://jobs.lever.co/s/p1", "2024-01-01 00:00:00")
    assert (rows["p2"].description, rows["p2"].url, rows["p2"].posted_at) == ("", "https://h", None)


def test_board_b_raw_array(spark, tmp_path):
    path = write(tmp_path, "raw.json", json.dumps([{"id": "1", "text": "x"}, {"id": "2"}]))
    assert [r.id for r in boards.read_board_b_raw(spark, path).orderBy("id").collect()] == ["1", "2"]


def pages(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"https://x/{i}", h) for i, h in enumerate(htmls)], "page_id int, url string, html string"
    )


def test_keyed_links(spark):
    page = (
        '<!-- <a data-jk="c" href="/c?jk=no">No</a> --><a title="href=/bad" data-jk href="/rc?jk=a1&amp;x=1"> A &amp; <b>B</b></a>'
        "<a href='https://h/v?from=y&jk=Zz9' id='job_7' data-x='>'>C</a><a data-jk=1 href='/none'>no key</a>"
        "<a data-jk='q' href='/e?jk=e'> </a><A DATA-JK='q' HREF=/u?jk=u1>U</A><a xdata-jk='1' href='/n?jk=n'>n</a>"
    )
    rows = html.job_links(pages(spark, page, "<p>nothing</p>"), max_jobs=2).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.url, r.title, r.jk) for r in rows] == [
        (0, 0, "https://www.indeed.com/rc?jk=a1&x=1", "A & B", "a1"), (0, 1, "https://h/v?from=y&jk=Zz9", "C", "Zz9"),
    ]
    assert html.job_links(pages(spark, page)).count() == 3


def test_card_links_with_nesting(spark):
    page = (
        '<div class="x jobTitleBig"><div><div>deep</div></div><a href="/1">One</a><a>no href</a></div>'
        '<a href="/out">Out</a><span data-testid="job-title"><a href="http://h/2"><i>Two</i> x</a></span>'
    )
    rows = html.job_links(pages(spark, page)).orderBy("pos").collect()
    assert [(r.url, r.title, r.jk) for r in rows] == [
        ("https://www.indeed.com/1", "One", None), ("http://h/2", "Two x", None)]


def test_details(spark):
    first = ('<h1 class="big title">T1</h1><div data-testid="inlineHeader-companyName"> Co </div>'
             '<div id="jobDescriptionText">Uses <div>Go<br>and  Rust</div> &amp; more</div><p>after</p>')
    second = '<h1>Plain</h1><div class="job-description">A<p>b</div><div class="job-description">C</div>'
    rows = {r.page_id: r for r in html.job_details(
        pages(spark, first, second, '<div class="job-description">  </div>', "<h1>x</h1>")).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0].title, rows[0].description, rows[0].company) == ("T1", "Uses Goand Rust & more", "Co")
    assert (rows[1].title, rows[1].description, rows[1].company) == ("Plain", "AbC", "")


def test_postings_take_all_or_the_first_links_with_details(spark):
    links = spark.createDataFrame(
        [(1, i, f"u{i}", f"t{i}", f"k{i}" if i % 2 else None) for i in range(20)],
        "page_id int, pos int, url string, title string, jk string")
    details = spark.createDataFrame(
        [(9, f"u{i}", "" if i == 2 else f"d{i}", "text", "") for i in (1, 2, 16)],
        "page_id int, url string, title string, description string, company string")
    rows = {r.pos: r for r in html.job_postings(links, details).collect()}
    first = {1: ("k1", "d1"), 2: ("u2", "t2")}
    assert {p: (r.posting_id, r.title) for p, r in rows.items()} == first | {16: ("u16", "d16")}
    assert {r.pos for r in html.job_postings(links, details, 15).collect()} == set(first)


def test_pagination(spark):
    page = ('<nav aria-label="pagination"><ul><li><a href="/p1"> 1 </a><li><a href="http://h/2">2</a></ul>'
            '<a href="/n">Next</a><a>3</a></nav><a href="/4">4</a><div data-testid="pagination"><b><a href="/5">05</a></b></div>')
    rows = html.pagination(pages(spark, page, "<a href='/1'>1</a>")).orderBy("page").collect()
    assert [(r.page, r.url) for r in rows] == [
        (1, "https://www.indeed.com/p1"), (2, "http://h/2"), (5, "https://www.indeed.com/5")]


def test_tokens(spark):
    df = pages(
        spark,
        '<script src="https://boards.greenhouse.io/embed/job_board?for=One"></script><a href="//greenhouse.io/jobs/two_2">x</a>',
        "text greenhouse.io/boards/raw and GREENHOUSE.io/boards/later",
        '<!-- <a href="greenhouse.io/jobs/hidden"> --> greenhouse.io/embed/job_board?for=shown',
        "<p>https://jobs.lever.co/Acme-1/x jobs.lever.co/b</p>",
        "<p>none</p>",
    )
    a = {r.page_id: r.token for r in html.discover_tokens(df, "greenhouse").collect()}
    assert a == {0: "two_2", 1: "raw", 2: "shown"}
    assert {r.page_id: r.token for r in html.discover_tokens(df, "lever").collect()} == {3: "Acme-1"}
    with pytest.raises(ValueError):
        html.discover_tokens(df, "other")


def test_registry(spark):
    df = spark.createDataFrame(
        [("A", "a.com", "lever", "t1", 2), ("A2", "a.com", "greenhouse", "t2", 3), ("B", "b.com", "lever", "t3", 1),
         ("A3", "a.com", "greenhouse", "t4", 4), ("Z", "z.com", "indeed", "t5", 0)],
        "company_name string, domain string, board string, token string, ord int")
    assert registry.registry_filter(df, "lever", "a.com").count() == 1
    assert {(r.domain, r.token) for r in registry.dedupe_by(df, "domain", "ord").collect()} == {
        ("a.com", "t1"), ("b.com", "t3"), ("z.com", "t5")}
    tasks = sorted((r.task, r.company_name) for r in registry.worklist(df).collect())
    assert tasks == [
        ("greenhouse:a.com", "A2"), ("greenhouse:a.com", "A3"), ("html_headers:a.com", "A2"),
        ("html_headers:b.com", "B"), ("lever:a.com", "A"), ("lever:b.com", "B")]


def test_pages_go_through_python_in_portions():
    body = "word " * (html.PORTION // 10)
    pages = [f'<h1>T{i}</h1><div id="jobDescriptionText">{i} {body}</div>' for i in range(5)] + ["<p>none</p>", '<div id="jobDescriptionText"> </div>']
    batch = pa.RecordBatch.from_pydict({"page_id": [0, 1, None, 3, 4, 5, 6], "url": list("abcdefg"), "html": pages})
    parts = list(html._details(iter([batch.slice(0, 0), batch])))
    assert max(sum(map(len, p["description"].to_pylist())) for p in parts) < 2 * html.PORTION and len(parts) > 2
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["page_id"], r["url"], r["title"]) for r in rows] == [(0, "a", "T0"), (1, "b", "T1"), (None, "c", "T2"), (3, "d", "T3"), (4, "e", "T4")]
    assert all(r["description"] == f"{i} {body}".strip() for i, r in enumerate(rows))


def test_cards_fill_only_pages_without_keyed_links(spark):
    card, keyed = '<h2 class="jobTitle"><a href="/c">C</a></h2>', '<a data-jk="k" href="/r?jk=k">K</a>'
    pages = spark.createDataFrame([(1, card), (2, keyed), (None, card), (4, None), (5, card + keyed)], "page_id long, html string").coalesce(1)
    got = {(r.page_id, r.title, r.jk) for r in html.job_links(pages).collect()}
    assert got == {(1, "C", None), (2, "K", "k"), (None, "C", None), (5, "K", "k")}

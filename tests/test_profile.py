from sigweave.operators import profile as p
from sigweave.operators.mentions import mentions
from sigweave.sources.taxonomy import default_aliases

ALIASES = default_aliases()
SCHEMA = (
    "domain string, source string, scraped_at timestamp, posting_id string, pos bigint,"
    " title string, description string"
)


def postings(spark, t, jobs, domain="a.com", source="lever"):
    return spark.createDataFrame(
        [(domain, source, t(1), str(i), i, title, text) for i, (title, text) in enumerate(jobs)], SCHEMA
    )


FOUR = [
    ("Senior Frontend Engineer", "React, TypeScript, GraphQL required"),
    ("Backend Engineer", "Python and Django, PostgreSQL, Redis"),
    ("DevOps Engineer", "Kubernetes, Docker, AWS, Terraform"),
    ("Frontend Engineer", "React and TypeScript with Next.js"),
]


def test_count_and_frequency(spark, t):
    rows = {r.canonical: r for r in p.tech_profile(postings(spark, t, FOUR), ALIASES).collect()}
    react = rows["React"]
    assert (react.job_mention_count, react.job_mention_frequency) == (2, 0.5)
    assert (react.confidence, react.sources, react.job_count) == (0.7, ["job_listing"], 4)


def test_counts_of_three(spark, t):
    jobs = [("Engineer 1", "Python and PostgreSQL"), ("Engineer 2", "Python and Redis"),
            ("Engineer 3", "Python, PostgreSQL, Redis")]
    rows = {r.canonical: r.job_mention_count for r in p.tech_profile(postings(spark, t, jobs), ALIASES).collect()}
    assert rows == {"Python": 3, "PostgreSQL": 2, "Redis": 2}


def test_order_is_first_seen(spark, t):
    jobs = [("x", "Redis then Python"), ("y", "React")]
    rows = p.tech_profile(postings(spark, t, jobs), ALIASES).orderBy("tech_ord").collect()
    # Within a posting the taxonomy's order counts: Python is listed before Redis.
    assert [r.canonical for r in rows] == ["Python", "Redis", "React"]


def test_postings_without_technology_count(spark, t):
    jobs = [("x", "Rust")] + [("nothing", None)] * 6
    row = p.tech_profile(postings(spark, t, jobs), ALIASES).collect()[0]
    assert (row.job_count, row.job_mention_frequency) == (7, 0.14)


def test_half_is_rounded_on_the_binary_value(spark):
    from pyspark.sql import functions as F
    from sigweave.functions.text import round2

    got = spark.createDataFrame([(0.145,), (0.125,), (1 / 3,)], "x double").select(round2(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.14, 0.13, 0.33]


def test_rollup_keeps_the_first_raw_mention(spark, t):
    jobs = [("x", "reactjs"), ("y", "react.js and React"), ("z", "vue")]
    m = mentions(postings(spark, t, jobs), ALIASES)
    rows = {r.canonical: r for r in p.mention_rollup(m).collect()}
    assert (rows["React"].posting_count, rows["React"].raw_mention) == (2, "reactjs")


def test_snapshot_round_trip_and_by_category(spark, t):
    pt = p.tech_profile(postings(spark, t, FOUR), ALIASES)
    snap = p.snapshot(pt)
    row = snap.collect()[0]
    assert (row.job_count, row.tech_count, len(row.tech_profile)) == (4, 12, 12)
    cols = ["domain", "source", "canonical", "confidence", "tech_ord", "job_count"]
    assert sorted(pt.select(cols).collect()) == sorted(p.unnest(snap).select(cols).collect())
    cats = {r.category: r.technologies for r in p.by_category(pt).collect()}
    assert cats["frontend"] == ["React", "Next.js"]
    # "Next.js" also holds the alias "js".
    assert cats["language"] == ["TypeScript", "Python", "JavaScript"]


def test_top_tech_is_cut_per_profile(spark, t):
    every = " , ".join(a.alias for a in ALIASES)
    pt = p.tech_profile(postings(spark, t, [("x", every)]), ALIASES)
    top = p.top_tech(pt).orderBy("rank").collect()
    assert len(top) == 15 and top[0].canonical == "React"
    assert pt.count() == 69


def signals(spark, rows):
    return spark.createDataFrame(
        [("a.com", g, s, c, "cat", raw) for g, s, c, raw in rows],
        "domain string, group_pos int, source string, canonical string, category string, raw_mention string",
    )


def test_scores(spark):
    rows = {
        r.canonical: r
        for r in p.score_signals(signals(spark, [
            (0, "job_listing", "A", "a1"), (1, "html_headers", "A", "a2"), (2, "job_listing", "A", "a3"),
            (0, "html_headers", "B", "b1"), (1, "github_org", "B", "b2"), (2, "press", "B", "b3"),
            (5, "press", "C", "c1"),
        ])).collect()
    }
    assert (rows["A"].confidence, rows["A"].sources, rows["A"].raw_mentions) == (
        0.75, ["job_listing", "html_headers"], ["a1", "a2"])
    assert rows["B"].confidence == 0.99
    assert rows["C"].confidence == 0.5


def test_scrapes_without_technology_are_in_the_report(spark, t):
    from sigweave.plans import report

    rows = postings(spark, t, [("Dev", "React")]).unionByName(postings(spark, t, [("x", "zz"), ("y", "zz")], domain="b.com"))
    snapshots = p.snapshot(p.tech_profile(rows, ALIASES, keep_empty=True))
    assert report.run_totals(snapshots).first().asDict() == {"total_companies": 2, "total_jobs": 3}
    companies = spark.createDataFrame([("a.com", "A")], "domain string, name string")
    got = {r.company_name: (r.job_count, r.tech_count, len(r.tech_profile), r.top_tech) for r in report.run_report(snapshots, companies).collect()}
    assert got["b.com"] == (2, 0, 0, []) and got["A"][:3] == (1, 1, 1)
    assert p.snapshot(p.tech_profile(rows, ALIASES)).count() == 1


def test_profiles_by_a_table_of_aliases(spark, t):
    from sigweave.sources.taxonomy import taxonomy_frame

    rows = postings(spark, t, FOUR + [("x", "zz")])
    want = sorted(map(str, p.tech_profile(rows, ALIASES, keep_empty=True).collect()))
    assert sorted(map(str, p.tech_profile(rows, taxonomy_frame(spark), keep_empty=True, strategy="join").collect())) == want
    assert sorted(map(str, p.tech_profile(rows, taxonomy_frame(spark), keep_empty=True).collect())) == want


def test_rollup_and_scores_are_ranked(spark, t):
    m = mentions(postings(spark, t, FOUR), ALIASES)
    ranked = {r["rank"]: (r.canonical, r.posting_count) for r in p.mention_rollup(m).collect()}
    assert ranked[1] == ("TypeScript", 2) or ranked[1] == ("React", 2)
    assert [ranked[i][1] for i in sorted(ranked)] == sorted((n for _, n in ranked.values()), reverse=True)

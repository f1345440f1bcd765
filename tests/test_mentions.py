import re

from hypothesis import HealthCheck, given, settings, strategies as st

from sigweave.operators import mentions as mention_operator
from sigweave.operators.mentions import mentions
from sigweave.sources.taxonomy import (
    Alias, alias_map, default_aliases, load_aliases, resolved, taxonomy_frame,
)

import pytest

ALIASES = default_aliases()


def brute_force(text, aliases=ALIASES):
    """Canonical -> longest alias (first on a tie), by testing every alias."""
    low, best = text.lower(), {}
    for a in resolved(aliases):
        if re.search(rf"(?<![a-z0-9]){re.escape(a.alias)}(?![a-z0-9])", low):
            if a.canonical not in best or len(a.alias) > len(best[a.canonical]):
                best[a.canonical] = a.alias
    return best


def extract(spark, texts, strategy="scan", aliases=ALIASES):
    df = spark.createDataFrame(
        [(i, "", x) for i, x in enumerate(texts)], "posting_id int, title string, description string"
    )
    taxonomy = taxonomy_frame(spark, aliases) if strategy == "join" else aliases
    rows = mentions(df, taxonomy, strategy, keep=("posting_id",)).collect()
    found = [{} for _ in texts]
    for r in rows:
        assert r.canonical not in found[r.posting_id]
        found[r.posting_id][r.canonical] = r.raw_mention
    return found


CASES = [
    ("We are looking for experience in React and TypeScript.", {"React", "TypeScript"}),
    ("Must know ReactJS and NodeJS", {"React", "JavaScript"}),
    ("We use react.js for our frontend", {"React", "JavaScript"}),
    ("Python, Django, PostgreSQL, Redis and Kubernetes.\nAWS and Docker; a Kafka-based pipeline.",
     {"Python", "Django", "PostgreSQL", "Redis", "Kubernetes", "AWS", "Docker", "Apache Kafka"}),
    ("We use Google Cloud Platform and Datadog for monitoring.", {"GCP", "Datadog"}),
    ("", set()),
    (None, set()),
    ("tf only", {"TensorFlow"}),
    ("C# on .NET (not asp.networks), angular 2+; k8s-ready", {"C#", "Angular", "Kubernetes"}),
    ("xreact reactx 1go go1", set()),
    ("aws sqs, php laravel, gitlab ci/cd", {"AWS", "SQS", "PHP", "Laravel", "GitLab CI"}),
    ("İstanbul ÉGo Goé", {"Go"}),
]


@pytest.mark.parametrize("strategy", ["scan", "join"])
def test_cases(spark, strategy):
    found = extract(spark, [c[0] for c in CASES], strategy)
    for (text, expected), got in zip(CASES, found):
        assert set(got) == expected, text
        assert got == brute_force(text or ""), text


def test_strategies_agree_on_null_keys(spark):
    rows = [("a", 1, "react"), ("a", None, "python and react"), (None, None, "docker"), (None, None, "react")]
    df = spark.createDataFrame([(d, i, "", x) for d, i, x in rows], "domain string, posting_id int, title string, description string")
    scan, join = (
        sorted(map(str, mentions(df, taxonomy_frame(spark), how, keep=("domain", "posting_id")).collect()))
        for how in ("scan", "join")
    )
    assert scan == join and len(scan) == 5


def test_longest_alias_is_kept_once(spark):
    assert extract(spark, ["React React React reactjs react.js"])[0]["React"] == "react.js"


def test_tie_keeps_the_first_listed(spark):
    tied = [Alias("X", "c", "abc", 0), Alias("X", "c", "xyz", 1)]
    assert extract(spark, ["xyz abc"], aliases=tied)[0] == {"X": "abc"}


def test_alias_map_last_owner_first_position(spark):
    rows = {r.alias: r for r in alias_map(taxonomy_frame(spark)).collect()}
    assert rows["tf"].canonical == "TensorFlow"
    listed = [a for a in ALIASES if a.alias == "tf"]
    assert rows["tf"].alias_ord == listed[0].alias_ord
    assert {(r.alias, r.canonical, r.alias_ord) for r in rows.values()} == {
        (a.alias, a.canonical, a.alias_ord) for a in resolved(ALIASES)
    }


def test_taxonomy_shape():
    assert len({a.canonical for a in ALIASES}) == 69
    assert len({a.category for a in ALIASES}) == 14
    assert (len(ALIASES), len({a.alias for a in ALIASES})) == (216, 215)


def test_large_taxonomy_is_refused_by_the_scan(spark):
    with pytest.raises(ValueError):
        load_aliases(taxonomy_frame(spark), limit=10)


pieces = st.one_of(
    st.sampled_from([a.alias for a in ALIASES]),
    st.sampled_from([" ", "", "-", ".", "x", "9", "é", "\n", "/", "+"]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=40, max_size=60))
def test_strategies_agree_with_brute_force(spark, texts):
    expected = [brute_force(x) for x in texts]
    assert extract(spark, texts, "scan") == expected
    assert extract(spark, texts, "join") == expected


def test_a_taxonomy_of_many_aliases(spark, monkeypatch):
    monkeypatch.setattr(mention_operator, "PATTERN_ALIASES", 300)
    many = ALIASES + [Alias(f"Tool {i}", "made", f"tool{i}{'.js' * (i % 2)}", 1000 + i) for i in range(1, 1000)]
    many += [Alias("Tool 7", "made", "tool7.js.net", 5000), Alias("Net", "made", ".net", 5001)]
    texts = ["Tool7.js.net and tool70", "tool999.js, react.js", "tool1 tool2 tool3.jsx", None, "", "tool 5 xtool6 tool6"]
    expected = [brute_force(x or "", many) for x in texts]
    assert extract(spark, texts, "join", many) == expected == extract(spark, texts, "scan", many)
    assert extract(spark, texts, "join", []) == [{}] * len(texts) == extract(spark, texts, "scan", [])


def test_neither_texts_nor_words_leave_a_task(spark):
    df = spark.createDataFrame([(1, "a", "b")], "posting_id int, title string, description string")
    plan = mentions(df, ALIASES, "join", keep=("posting_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    for line in plan.split("\n"):
        assert not ("Exchange" in line and ("description" in line or "title" in line))


def test_the_text_is_searched_once(spark):
    df = spark.createDataFrame([(1, "a", "b")], "posting_id int, title string, description string")
    plan = mentions(df, ALIASES, keep=("posting_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "Exchange" not in plan

import html

from pyspark.sql import functions as F

from sigweave.functions.text import decode_entities, strip_html, valid_domain
from sigweave.operators import header_signals as hs


def stripped(spark, texts, mode):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(strip_html(F.col("x"), mode)).collect()]


def test_full(spark):
    cases = {
        "&amp;lt;": "<",
        "a&#39;b": "a b",
        "<STYLE>p{}</style>a<script x>var b='<c>';</SCRIPT>d": "ad",
        "<p>one</p><p>two</p>": "one two",
        "a\nb": "a\nb",
        "a \n b": "a b",
        " ﻿ x 　y  ": "x y",
        "&lt;b&gt; &nbsp;R&amp;D": "<b> R&D",
        "a &#x27; b": "a &#x27; b",
        None: None,
    }
    assert stripped(spark, list(cases), "full") == list(cases.values())


def test_short_keeps_script_text_and_other_entities(spark):
    assert stripped(spark, ["<script>x</script> &lt;&amp;&nbsp; y&#39;"], "short") == ["x &lt;& y&#39;"]


def test_domains(spark):
    good = ["ab.co", "Stripe.com", "a-b.c-d.io", "1x.org"]
    bad = ["", "a", "a.co", "-a.com", "a.c", "a b.com", "a.com\n", "x" * 250 + ".com", "a.c0m", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "d string")
    assert {r.d for r in df.filter(valid_domain(F.col("d"))).collect()} == set(good)


def captures(spark, t, rows):
    return spark.createDataFrame(
        [(f"d{i}", f"D{i}", h, b, t(1)) for i, (h, b) in enumerate(rows)],
        "domain string, company_name string, headers map<string,string>, body string, scraped_at timestamp",
    )


def profiles(spark, t, rows):
    out = {}
    for r in hs.header_profile(captures(spark, t, rows)).orderBy("domain", "tech_ord").collect():
        out.setdefault(r.domain, []).append((r.canonical, r.confidence, r.sources[0]))
    return out


def test_meta_outranks_header_in_its_place(spark, t):
    got = profiles(spark, t, [
        ({"X-Generator": "WordPress 6", "server": "nginx"}, '<meta name="generator" content="WordPress 6.4">'),
    ])
    assert got["d0"] == [("Nginx", 0.92, "http_headers"), ("WordPress", 0.95, "meta_generator")]


def test_rules(spark, t):
    got = profiles(spark, t, [
        ({"server": "cloudflare", "cf-ray": "1"}, None),
        ({"x-netlify": "", "X-Vercel-Id": "a"}, ""),
        ({"SERVER": "Microsoft-IIS/10", "server": "nginx"}, "x"),
        ({}, "<META content='Hugo, Gatsby' data-x name='generator'>"),
        (None, "x" * 4090 + "<meta name='generator' content='Hugo'>"),
        ({"content-type": "text/html"}, "<p>none</p>"),
    ])
    assert got["d0"] == [("Cloudflare", 0.92, "http_headers")]
    assert got["d1"] == [("Vercel", 0.92, "http_headers")]
    assert len(got["d2"]) == 1
    assert [x[0] for x in got["d3"]] == ["Gatsby", "Hugo"]
    assert [x[0] for x in got["d4"]] == ["Hugo"]
    assert "d5" not in got


def test_null_headers_do_not_hide_the_generator(spark, t):
    got = profiles(spark, t, [(None, "<meta name='generator' content='Hugo'>")])
    assert got["d0"] == [("Hugo", 0.95, "meta_generator")]


def test_header_profile_has_no_shuffle(spark, t):
    plan = hs.header_profile(captures(spark, t, [({}, "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_header_rows(spark, t):
    rows = hs.header_rows(captures(spark, t, [({"Server": "x", "A": "1"}, "")])).collect()
    assert {(r.header, r.value) for r in rows} == {("server", "x"), ("a", "1")}


def test_a_generator_tag_counts_wherever_it_stands(spark):
    from sigweave.operators.header_signals import generator_value

    body = "x" * 10_000 + '<meta name="generator" content="WordPress 6.1">'
    row = spark.createDataFrame([(body,)], "body string").select(generator_value(F.col("body")).alias("g")).first()
    assert row.g == "WordPress 6.1"


def test_entities_decode_as_html_defines_them(spark):
    cases = [
        "D&eacute;v &#233; &ndash; R&#x27;D", "&amp;lt;", "&lt", "&notit; &notin; &not", "&copyright &copy=1", "&#0;&#128;&#x9F;&#129;&#xD800;&#1114112;",
        "&#1;&#11;&#13;&#xFFFE;&#64976;&#127;", "&#99999999999999999999;&#x0000000041;", "&#x1F600;\U0001f600&#128512", "&unknown; & &; &# &#x;", "a&b=c",
        "&CounterClockwiseContourIntegral;&NotEqualTilde;&fjlig;", "", "plain", "&&amp;&amp", "&nbsp;x&hellip",
    ]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "s string")
    got = [r.d for r in df.select(F.col("s"), decode_entities(F.col("s")).alias("d")).collect()]
    assert got == [html.unescape(c) for c in cases] + [None]


def test_names_in_addresses_need_a_semicolon(spark):
    cases = {"?a=1&copy=2&lt;&amp;x&reg": "?a=1&copy=2<&x®", "&copyright=1&eacute;": "&copyright=1é", "&#233&para.": "é¶."}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert [r.d for r in df.select(decode_entities(F.col("s"), attribute=True).alias("d")).collect()] == list(cases.values())

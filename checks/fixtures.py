"""The data model's tables, derived from the driver tables by arithmetic both engines can repeat.

Every row of a driver table is used; numbers only decide what a row's columns say.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigweave.operators.billing import COMPLETED, DELETED, UPDATED
from sigweave.session import spread
from sigweave.sources.taxonomy import default_aliases

ALIASES = default_aliases()
N = len(ALIASES)
DAY0 = "2024-01-01"
# Scrapes before this day are the previous version, later ones the current.
SPLIT = "2024-01-08"
NOW = "2024-02-01"


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
              " props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table whose texts cost work per row."""
    return spread(load(spark, sf_dir, table), key)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def day(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(DAY0).cast("timestamp")) + n * 86_400)


def alias_at(index: Column) -> Column:
    every = F.split(F.lit("|".join(a.alias for a in ALIASES)), r"\|")
    return F.get(every, (index % N).cast("int"))


def _numbers(documents: DataFrame) -> DataFrame:
    k = F.floor(F.col("doc_id") / 20)
    return documents.withColumn("k", k).withColumn(
        "sn", F.expr("cast(substring(source, 4) as bigint)")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``posting`` from documents: 20 companies, three boards, two scrapes each."""
    d = _numbers(texts(spark, sf_dir, "documents", "doc_id"))
    snap = F.floor(F.col("doc_id") / 60) % 2
    return d.select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.upper("source").alias("company_name"),
        F.when(F.col("k") % 3 == 0, "greenhouse")
        .when(F.col("k") % 3 == 1, "lever")
        .otherwise("indeed")
        .alias("source"),
        day(snap * 7 + (F.col("k") + F.col("sn")) % 3).alias("scraped_at"),
        F.col("doc_id").cast("string").alias("posting_id"),
        F.col("doc_id").alias("pos"),
        F.lit("Engineer").alias("title"),
        F.concat(
            "text", F.lit(" "), alias_at(F.col("sn") * 5 + F.col("k") % 7),
            F.lit(" x"), alias_at(F.col("doc_id") * 13),
            F.lit(" "), alias_at(F.col("doc_id") * 31),
        ).alias("description"),
    )


def payloads_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board A responses from documents: one or two jobs each, some without a jobs array."""
    d = _numbers(texts(spark, sf_dir, "documents", "doc_id"))
    i = F.col("doc_id")
    job = F.struct(
        i.alias("id"),
        F.when(i % 5 != 0, F.concat(F.lit("Engineer "), i.cast("string"))).alias("title"),
        F.concat(
            F.lit("<style>p{x}</style><p>"), "text", F.lit("</p>&amp;lt;b&nbsp; <b>"),
            alias_at(i * 13), F.lit("</b>&#39;s"),
        ).alias("content"),
        F.when(i % 3 != 0, F.struct(F.concat(F.lit("City "), "lang").alias("name"))).alias("location"),
        F.when(i % 4 == 1, F.array(F.struct(F.lit("Data").alias("name"), )))
        .when(i % 4 == 2, F.array(F.struct(F.lit("Web").alias("name")), F.struct(F.lit("Ops").alias("name"))))
        .alias("departments"),
        F.when(i % 2 == 0, F.concat(F.lit("https://jobs.example.com/"), i.cast("string")))
        .alias("absolute_url"),
        F.when(i % 6 != 0, F.date_format(day(i % 28), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("updated_at"),
    )
    second = job.withField("id", i + 1_000_000).withField("title", F.lit("Second"))
    return d.select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.upper("source").alias("company_name"),
        F.col("source").alias("token"),
        day(F.lit(0)).alias("scraped_at"),
        F.when(i % 10 == 0, F.lit(None))
        .when(i % 10 < 5, F.array(job, second))
        .otherwise(F.array(job))
        .alias("jobs"),
    )


def payloads_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board B responses from documents: one posting each, some not an array."""
    d = _numbers(texts(spark, sf_dir, "documents", "doc_id"))
    i = F.col("doc_id")
    lists = F.array(
        F.struct(
            F.lit("Requirements").alias("text"),
            F.concat(F.lit("<li>"), alias_at(i * 13), F.lit("</li>&amp;&nbsp;<li>x</li>")).alias("content"),
        ),
        F.struct(
            F.when(i % 2 == 0, F.lit("Extras")).otherwise(F.lit("")).alias("text"),
            F.when(i % 4 < 2, F.concat(F.lit("<b>"), alias_at(i * 31), F.lit("</b>"))).alias("content"),
        ),
    )
    posting = F.struct(
        F.concat(F.lit("b-"), i.cast("string")).alias("id"),
        F.when(i % 7 != 0, F.concat(F.lit("Developer "), "lang")).alias("text"),
        F.col("text").alias("descriptionPlain"),
        F.when(i % 3 == 0, F.lit("We hire.")).when(i % 3 == 1, F.lit("")).alias("additionalPlain"),
        F.when(i % 5 != 0, lists).alias("lists"),
        F.when(
            i % 6 != 0,
            F.struct(
                F.concat(F.lit("City "), "lang").alias("location"),
                F.when(i % 2 == 0, F.lit("Data")).alias("department"),
                F.lit("Core").alias("team"),
            ),
        ).alias("categories"),
        F.when(i % 2 == 1, F.concat(F.lit("https://jobs.example.com/b/"), i.cast("string")))
        .alias("hostedUrl"),
        F.when(i % 8 != 0, F.lit(1_704_067_200_000) + i * 1000).alias("createdAt"),
    )
    return d.select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.upper("source").alias("company_name"),
        F.col("source").alias("slug"),
        day(F.lit(0)).alias("scraped_at"),
        F.when(i % 10 != 9, F.array(posting)).alias("postings"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header captures from pages: seven header sets, generator tags in both attribute orders."""
    p = texts(spark, sf_dir, "pages", "page_id")
    i = F.col("page_id")

    def headers(**kv: str) -> Column:
        pairs = [F.lit(x) for k, v in kv.items() for x in (k.replace("_", "-"), v)]
        return F.create_map(*pairs)

    sets = [
        headers(Server="nginx/1.25", X_Powered_By="PHP/8.2", content_type="text/html"),
        headers(server="cloudflare", CF_Ray="8a1b", X_Generator="WordPress 6.4"),
        headers(server="Apache (Fastly)", via="1.1 varnish, CloudFront"),
        headers(X_Powered_By="Next.js", x_vercel_id="iad1::x", x_netlify=""),
        headers(Server="Microsoft-IIS/10.0", X_Powered_By="ASP.NET"),
        headers(x_request_id="heroku-1", x_amz_request_id="A1", x_amzn_requestid="A2"),
        headers(content_type="text/html", server="envoy", x_envoy_upstream_service_time="3"),
    ]
    chosen = F.get(F.array(*sets), (i % 7).cast("int"))
    generator = F.get(
        F.array(*[F.lit(g) for g in (
            "WordPress 6.4", "Drupal 10", "Hugo 0.1 with Gatsby", "Unknown CMS", "next.js",
        )]),
        (i % 5).cast("int"),
    )
    tag = F.when(
        i % 2 == 0,
        F.concat(F.lit('<meta name="generator" content="'), generator, F.lit('">')),
    ).otherwise(
        F.concat(F.lit("<meta content='"), generator, F.lit("' name='Generator'>"))
    )
    return p.select(
        F.concat(F.lit("site"), i.cast("string"), F.lit(".example.com")).alias("domain"),
        F.concat(F.lit("Site "), i.cast("string")).alias("company_name"),
        chosen.alias("headers"),
        F.when(i % 3 == 0, F.col("html")).otherwise(F.concat(tag, "html")).alias("body"),
        day(i % 3).alias("scraped_at"),
    )


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages from pages: keyed links on two of three, title cards on the rest, page numbers."""
    p = texts(spark, sf_dir, "pages", "page_id")
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    keyed = F.concat(
        F.lit('<a class="x" data-jk="k" href="/rc/clk?jk=ab'), s, F.lit('&amp;from=x"><b>Data</b> &amp; Web D&eacute;v &#233;&ndash;R&#x27;D &copy &amp;lt; '),
        s, F.lit('</a><a id="job_1" href="https://jobs.example.com/v?jk=cd'), s,
        F.lit("\"> Dev\n</a><a id='job_2' href='/nokey'>No key</a><a data-jk='z' href='/rc/clk?jk=ef'>  </a>"),
    )
    cards = F.concat(
        F.lit('<h2 class="big jobTitle"><span><a href="/viewjob?n='), s,
        F.lit('">Card '), s, F.lit('</a></span></h2><div data-testid="job-title"><a href="https://jobs.example.com/c/'),
        s, F.lit('">Other</a></div>'),
    )
    numbers = F.concat(
        F.lit('<nav aria-label="pagination"><ul><li><a href="/jobs?start='), s,
        F.lit('">1</a></li><li><a href="https://jobs.example.com/p"> 2 </a></li><li><a href="/next">Next</a></li></ul></nav>'),
    )
    return p.select(
        "page_id", "url",
        F.concat("html", F.when(i % 3 == 0, cards).otherwise(keyed), F.when(i % 2 == 0, numbers).otherwise("")).alias("html"),
    )


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job pages from pages: the article inside one of the known containers, or none of them."""
    p = texts(spark, sf_dir, "pages", "page_id")
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    container = F.get(
        F.array(*[F.lit(x) for x in (
            '<div id="jobDescriptionText">', '<div class="job-description">',
            '<section class="a jobsearch-jobDescriptionText b">', '<div class="other">',
        )]),
        (i % 4).cast("int"),
    )
    closing = F.when(i % 4 == 2, "</section>").otherwise("</div>")
    return p.select(
        "page_id",
        F.when(i % 3 == 0, F.concat(F.lit("https://www.indeed.com/viewjob?n="), s))
        .otherwise(F.concat(F.lit("https://www.indeed.com/rc/clk?jk=ab"), s, F.lit("&from=x")))
        .alias("url"),
        F.concat(
            F.lit('<span data-testid="inlineHeader-companyName"> Co '), s, F.lit("</span>"),
            container, F.lit("<div>Role "), s, F.lit("</div><p>"), "html", F.lit("</p>"), closing,
        ).alias("html"),
    )


def career_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Careers pages from pages: board links in tags, in plain text, or absent."""
    p = texts(spark, sf_dir, "pages", "page_id")
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    added = F.get(
        F.array(
            F.concat(
                F.lit('<script src="https://boards.greenhouse.io/embed/job_board?for=acme-'), s,
                F.lit('"></script><a href="https://boards.greenhouse.io/jobs/Last_'), s, F.lit('">x</a>'),
            ),
            F.concat(F.lit("see greenhouse.io/boards/raw"), s, F.lit(" or greenhouse.io/boards/two")),
            F.concat(F.lit("<p>https://jobs.lever.co/Lev-"), s, F.lit("/1 jobs.lever.co/second</p>")),
            F.lit("<p>no board</p>"),
        ),
        (i % 4).cast("int"),
    )
    return p.select("page_id", "url", F.concat("html", added).alias("html"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows from customers; three customers share a domain."""
    c = load(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("company-"), F.floor(i / 3).cast("string"), F.lit(".example.com")).alias("domain"),
        F.when(i % 2 == 0, "greenhouse").otherwise("lever").alias("board"),
        F.concat(F.lit("t"), i.cast("string")).alias("token"),
        i.alias("ord"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of the postings, and one per customer."""
    d = load(spark, sf_dir, "documents").select("source").distinct()
    of_postings = d.select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.upper("source").alias("name"),
        day(F.lit(0)).alias("created_at"),
        day(F.expr("cast(substring(source, 4) as bigint)") % 5).alias("updated_at"),
    )
    c = load(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    of_customers = c.select(
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".example.com")).alias("domain"),
        F.col("c_name").alias("name"),
        day(i % 7).alias("created_at"),
        F.when(i % 50 != 0, day(i % 28)).alias("updated_at"),
    )
    return of_postings.unionByName(of_customers)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key_id"),
        F.concat(F.lit("/v1/"), F.col("event_type")).alias("url"),
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "signup", 404)
        .otherwise(200)
        .alias("status"),
        F.col("value").alias("ms"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key per user seen in the events; limits low enough that some are exceeded."""
    e = load(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return e.select(
        F.concat(F.lit("key-"), u.cast("string")).alias("key_id"),
        F.when(u % 2 == 0, "starter").otherwise("pro").alias("plan"),
        F.when(u % 3 != 0, F.lit(1)).alias("requests_per_minute"),
        (F.lit(55) + u % 10).cast("int").alias("monthly_limit"),
        F.when(u % 4 == 0, F.concat(F.lit("old-"), u.cast("string"))).alias("customer"),
        F.when(u % 4 == 0, F.concat(F.lit("oldsub-"), u.cast("string"))).alias("subscription"),
    )


def all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the log, some deactivated, and keys that no request names."""
    c = load(spark, sf_dir, "customer").filter("c_custkey % 50 = 0")
    idle = c.select(
        F.concat(F.lit("idle-"), F.col("c_custkey").cast("string")).alias("key_id"),
        F.when(F.col("c_custkey") % 100 != 0, F.lit(50)).alias("monthly_limit"), F.lit(None).cast("boolean").alias("is_active"),
    )
    active = F.substring("key_id", 5, 20).cast("bigint") % 7 != 0
    return api_keys(spark, sf_dir).select("key_id", "monthly_limit", active.alias("is_active")).unionByName(idle)


def quiet_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two postings each, without any technology, of companies that have no others."""
    c = load(spark, sf_dir, "customer").filter("c_custkey % 50 = 0")
    return c.select("c_custkey", "c_name", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i")).select(
        F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".example.com")).alias("domain"),
        F.col("c_name").alias("company_name"),
        F.lit("lever").alias("source"),
        day(F.col("c_custkey") % 5).alias("scraped_at"),
        F.concat_ws("-", F.lit("q"), F.col("c_custkey").cast("string"), F.col("i").cast("string")).alias("posting_id"),
        F.col("i").cast("bigint").alias("pos"),
        F.lit("Zzz").alias("title"),
        F.lit("zz zzz").alias("description"),
    )


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    plans = F.array(*[F.lit(p) for p in ("starter", "pro", "enterprise", "unheard")])
    return e.select(
        i.alias("seq"),
        F.when(kind == "signup", COMPLETED).when(kind == "purchase", UPDATED)
        .when(kind == "error", DELETED).otherwise("invoice.payment_failed").alias("type"),
        F.when(i % 11 != 0, F.concat(F.lit("key-"), F.col("user_id").cast("string"))).alias("key_id"),
        F.get(plans, (i % 4).cast("int")).alias("plan"),
        F.when(i % 3 == 0, "past_due").otherwise("active").alias("status"),
        F.when(i % 9 != 0, F.concat(F.lit("cus-"), i.cast("string"))).alias("customer"),
        F.concat(F.lit("sub-"), i.cast("string")).alias("subscription"),
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("subscription_id"),
        (F.col("event_type") != "error").alias("ok"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per customer: a few for all domains, most for two, a segment inactive."""
    c = load(spark, sf_dir, "customer")
    i = F.col("c_custkey")

    def site(n: Column) -> Column:
        return F.concat(F.lit("src"), (n % 20).cast("string"), F.lit(".example.com"))

    everywhere = (F.col("c_nationkey") == 7) & (F.col("c_mktsegment") == "BUILDING")
    return c.select(
        F.concat(F.lit("sub-"), i.cast("string")).alias("id"),
        F.concat(F.lit("https://hooks.example.com/"), i.cast("string")).alias("url"),
        F.when(i % 3 == 0, F.array(F.lit("tech_added")))
        .when(i % 3 == 1, F.array(F.lit("tech_removed"), F.lit("confidence_change")))
        .otherwise(F.array(F.lit("tech_added"), F.lit("tech_removed")))
        .alias("events"),
        F.when(~everywhere, F.array(site(i), site(i * 3))).alias("domains"),
        (F.col("c_mktsegment") != "MACHINERY").alias("is_active"),
    )


def run_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a run from customers: one a company, a few skipped or failed."""
    c = load(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    failed = i % 13 == 0
    return c.select(
        F.when(i % 3 == 0, "greenhouse").when(i % 3 == 1, "lever").otherwise("html_headers").alias("run_type"),
        F.col("c_name").alias("company"),
        F.when(failed, "fail").when(i % 7 == 0, "skip").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("timeout "), "c_name")).alias("error"),
        day(i % 3).alias("started_at"),
        day(i % 3 + 1).alias("completed_at"),
    )


def signal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal groups from documents: each document is a group of two technologies of one source."""
    d = _numbers(load(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in (
        "job_listing", "html_headers", "github_org", "g2_profile", "linkedin", "press",
    )])
    techs = F.from_json(
        F.lit(json.dumps([
            {"canonical": a.canonical, "category": a.category, "raw_mention": a.alias}
            for a in ALIASES
        ])),
        "array<struct<canonical: string, category: string, raw_mention: string>>",
    )
    return d.select(
        F.concat("source", F.lit(".example.com")).alias("domain"),
        i.alias("group_pos"),
        F.get(kinds, ((F.col("k") * 7 + F.col("sn")) % 6).cast("int")).alias("source"),
        F.posexplode(F.array(
            F.get(techs, ((i * 13) % N).cast("int")), F.get(techs, ((i * 31) % N).cast("int")),
        )).alias("tech_pos", "t"),
    ).select("domain", "group_pos", "source", "tech_pos", "t.*")

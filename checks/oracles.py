"""SQL for DuckDB that gives the result of each registered query on the same tables.

Written independently of the Spark code: plain joins, grouping and anti-joins where the library
uses array functions, windows over whole groups where it splits them.
"""

from __future__ import annotations

from checks.fixtures import ALIASES, N
from checks.queries import EXCLUDES, USES, USES_ANY, WORDS
from sigweave.functions.text import WHITESPACE
from sigweave.operators.billing import COMPLETED, DELETED, UPDATED
from sigweave.sources.rules import GENERATOR_RULES, HEADER_RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(f"{v}::BIGINT" if isinstance(v, int) else quoted(v) for v in row) + ")"
        for row in rows
    )


def names(items) -> str:
    return ", ".join(quoted(i) for i in items)


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def trimmed(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"


def collapsed(expr: str) -> str:
    return trimmed(f"regexp_replace({expr}, '{WHITESPACE}{{2,}}', ' ', 'g')")


def replaced(expr: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {quoted(old)}, {quoted(new)})"
    return expr


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


DAY0 = "TIMESTAMP '2024-01-01'"
NOW = "TIMESTAMP '2024-02-01'"
SPLIT = "TIMESTAMP '2024-01-08'"


def day(n: str) -> str:
    return f"({DAY0} + to_days(CAST({n} AS INTEGER)))"


# -- fixtures -------------------------------------------------------------------------------

TAXONOMY = f"taxonomy(canonical, category, alias, alias_ord) AS ({values(ALIASES)})"

AMAP = """
amap AS (
  SELECT alias, arg_max(canonical, alias_ord) AS canonical, arg_max(category, alias_ord) AS category,
         min(alias_ord) AS alias_ord
  FROM taxonomy GROUP BY alias)
"""

DOCS = """
docs AS (
  SELECT doc_id, text, lang, source AS src, doc_id // 20 AS k, CAST(substr(source, 4) AS BIGINT) AS sn
  FROM documents)
"""

POSTING = f"""
posting AS MATERIALIZED (
  SELECT src || '.example.com' AS domain,
         CASE k % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'indeed' END AS source,
         {day("((doc_id // 60) % 2) * 7 + (k + sn) % 3")} AS scraped_at,
         CAST(doc_id AS VARCHAR) AS posting_id, doc_id AS pos,
         lower('Engineer ' || text || ' ' || a.alias || ' x' || b.alias || ' ' || c.alias) AS low
  FROM docs
  JOIN taxonomy a ON a.alias_ord = (sn * 5 + k % 7) % {N}
  JOIN taxonomy b ON b.alias_ord = (doc_id * 13) % {N}
  JOIN taxonomy c ON c.alias_ord = (doc_id * 31) % {N})
"""


def hits(source: str, table: str, keep: str) -> str:
    """Alias matches in the column ``low``; the boundary is part of the match, as RE2 cannot look around."""
    return f"""
maybe AS MATERIALIZED (
  SELECT {keep}, low, canonical, category, alias, alias_ord
  FROM {source} JOIN {table} ON contains(low, alias)),
hit AS (
  SELECT * FROM maybe
  WHERE regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])')),
mention AS MATERIALIZED (
  SELECT {keep}, canonical, category,
         first(alias ORDER BY length(alias) DESC, alias_ord) AS raw_mention, min(alias_ord) AS alias_ord
  FROM hit GROUP BY {keep}, canonical, category)
"""


KEEP = "domain, source, scraped_at, posting_id, pos"
MENTIONS = [TAXONOMY, AMAP, DOCS, POSTING, hits("posting", "amap", KEEP)]

PROFILE = """
sizes AS (SELECT domain, source, scraped_at, count(*) AS n FROM posting GROUP BY ALL),
counted AS (
  SELECT domain, source, scraped_at, canonical, category, count(*) AS c, min(pos) AS p,
         arg_min(alias_ord, pos) AS o
  FROM mention GROUP BY domain, source, scraped_at, canonical, category),
pt AS MATERIALIZED (
  SELECT domain, source, scraped_at, canonical, category, CAST(0.7 AS DOUBLE) AS confidence,
         'job_listing' AS sources, c AS job_mention_count,
         floor(CAST(c AS DOUBLE) / n * 100 + 0.5) / 100 AS job_mention_frequency, n AS job_count,
         row_number() OVER (PARTITION BY domain, source, scraped_at ORDER BY p, o) AS tech_ord
  FROM counted JOIN sizes USING (domain, source, scraped_at))
"""
PROFILES = [*MENTIONS, PROFILE]

SNAPSHOT = """
snap AS MATERIALIZED (
  SELECT domain, source, scraped_at, max(job_count) AS job_count, count(*) AS tech_count,
         string_agg(canonical, '|' ORDER BY tech_ord) AS technologies
  FROM pt GROUP BY domain, source, scraped_at),
current_by_source AS (
  SELECT s.* FROM snap s
  WHERE NOT EXISTS (SELECT 1 FROM snap o WHERE o.domain = s.domain AND o.source = s.source
                    AND o.scraped_at > s.scraped_at)),
latest AS (
  SELECT DISTINCT ON (domain) * FROM snap ORDER BY domain, scraped_at DESC, source),
latest_tech AS (SELECT pt.* FROM pt SEMI JOIN latest USING (domain, source, scraped_at))
"""
SNAPSHOTS = [*PROFILES, SNAPSHOT]

COMPANY = f"""
company AS (
  SELECT DISTINCT source || '.example.com' AS domain, upper(source) AS name, {DAY0} AS created_at,
         {day("CAST(substr(source, 4) AS BIGINT) % 5")} AS updated_at
  FROM documents
  UNION ALL
  SELECT replace(lower(c_name), '#', '-') || '.example.com', c_name, {day("c_custkey % 7")},
         CASE WHEN c_custkey % 50 <> 0 THEN {day("c_custkey % 28")} END
  FROM customer)
"""

REGISTRY = """
registry AS (
  SELECT c_name AS company_name, 'company-' || (c_custkey // 3) || '.example.com' AS domain,
         CASE WHEN c_custkey % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS board,
         't' || c_custkey AS token, c_custkey AS ord
  FROM customer)
"""


def diff(old: str, new: str, name: str = "event") -> str:
    """Added and removed technologies by anti-join; only refreshed profiles count."""
    return f"""
{name} AS MATERIALIZED (
  SELECT domain, source, 'added' AS event_type, canonical, category,
         CAST(NULL AS DOUBLE) AS old_confidence, confidence AS new_confidence
  FROM {new} n
  WHERE NOT EXISTS (SELECT 1 FROM {old} o WHERE o.domain = n.domain AND o.source = n.source
                    AND o.canonical = n.canonical)
  UNION ALL
  SELECT domain, source, 'removed', canonical, category, confidence, NULL
  FROM {old} o
  WHERE EXISTS (SELECT 1 FROM {new} n WHERE n.domain = o.domain AND n.source = o.source)
    AND NOT EXISTS (SELECT 1 FROM {new} n WHERE n.domain = o.domain AND n.source = o.source
                    AND n.canonical = o.canonical))
"""


VERSIONS = f"""
old_pt AS (SELECT * FROM pt WHERE scraped_at < {SPLIT}),
new_pt AS (SELECT * FROM pt WHERE scraped_at >= {SPLIT})
"""
EVENTS = [*PROFILES, VERSIONS, diff("old_pt", "new_pt")]
EVENT_COLUMNS = (
    "domain, source, event_type, canonical, category, old_confidence, new_confidence, "
    f"{ts(NOW)} AS detected_at"
)


def merged(table: str, name: str) -> str:
    """Merge over the current profiles of a domain, newest first."""
    return f"""
{name}_age AS (
  SELECT domain, source, scraped_at,
         row_number() OVER (PARTITION BY domain ORDER BY scraped_at DESC, source) AS age,
         max(scraped_at) OVER (PARTITION BY domain) AS last_scraped
  FROM (SELECT domain, source, max(scraped_at) AS scraped_at FROM {table} GROUP BY domain, source)),
{name} AS MATERIALIZED (
  SELECT domain, canonical, arg_min(category, age) AS category,
         round(least(0.99, arg_min(confidence, age) + 0.05 * (count(*) - 1)), 4) AS confidence,
         'job_listing' AS sources, max(job_mention_count) AS job_mention_count,
         max(job_mention_frequency) AS job_mention_frequency, max(last_scraped) AS last_scraped,
         min(age) AS first_age, arg_min(tech_ord, age) AS first_ord
  FROM {table} JOIN {name}_age USING (domain, source, scraped_at)
  GROUP BY domain, canonical)
"""


CAPTURE = f"""
capture AS MATERIALIZED (
  SELECT page_id, 'site' || page_id || '.example.com' AS domain, {day("page_id % 3")} AS scraped_at,
         page_id % 7 AS kind,
         CASE WHEN page_id % 3 = 0 THEN html ELSE
           CASE WHEN page_id % 2 = 0 THEN '<meta name="generator" content="' || gen || '">'
                ELSE '<meta content=''' || gen || ''' name=''Generator''>' END || html END AS body
  FROM (SELECT *, CASE page_id % 5 WHEN 0 THEN 'WordPress 6.4' WHEN 1 THEN 'Drupal 10'
                  WHEN 2 THEN 'Hugo 0.1 with Gatsby' WHEN 3 THEN 'Unknown CMS' ELSE 'next.js' END AS gen
        FROM pages)),
header_set(kind, header, value) AS (VALUES
  (0, 'server', 'nginx/1.25'), (0, 'x-powered-by', 'PHP/8.2'), (0, 'content-type', 'text/html'),
  (1, 'server', 'cloudflare'), (1, 'cf-ray', '8a1b'), (1, 'x-generator', 'WordPress 6.4'),
  (2, 'server', 'Apache (Fastly)'), (2, 'via', '1.1 varnish, CloudFront'),
  (3, 'x-powered-by', 'Next.js'), (3, 'x-vercel-id', 'iad1::x'), (3, 'x-netlify', ''),
  (4, 'server', 'Microsoft-IIS/10.0'), (4, 'x-powered-by', 'ASP.NET'),
  (5, 'x-request-id', 'heroku-1'), (5, 'x-amz-request-id', 'A1'), (5, 'x-amzn-requestid', 'A2'),
  (6, 'content-type', 'text/html'), (6, 'server', 'envoy'), (6, 'x-envoy-upstream-service-time', '3')),
header_rule(rule_ord, header, pattern, canonical, category) AS (
  {values([(i, *r) for i, r in enumerate(HEADER_RULES)])}),
generator_rule(rule_ord, pattern, canonical, category) AS (
  {values([(i, *r) for i, r in enumerate(GENERATOR_RULES)])}),
header_signal AS (
  SELECT domain, scraped_at, rule_ord, canonical, category, CAST(0.92 AS DOUBLE) AS confidence,
         'http_headers' AS source
  FROM capture JOIN header_set USING (kind) JOIN header_rule USING (header)
  WHERE value <> '' AND regexp_matches(value, pattern, 'i')),
generator_tag AS (
  SELECT domain, scraped_at,
         coalesce(nullif(regexp_extract(body, '<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)["'']', 1, 'i'), ''),
                  nullif(regexp_extract(body, '<meta[^>]+content=["'']([^"'']+)["''][^>]+name=["'']generator["'']', 1, 'i'), '')) AS generator
  FROM capture),
generator_signal AS (
  SELECT domain, scraped_at, generator, rule_ord, canonical, category, CAST(0.95 AS DOUBLE) AS confidence,
         'meta_generator' AS source
  FROM generator_tag JOIN generator_rule ON regexp_matches(generator, pattern, 'i')),
signal AS (
  SELECT domain, scraped_at, rule_ord, canonical, category, confidence, source FROM header_signal
  UNION ALL
  SELECT domain, scraped_at, rule_ord + {len(HEADER_RULES)}, canonical, category, confidence, source
  FROM generator_signal),
header_pt AS MATERIALIZED (
  SELECT domain, 'html_headers' AS source, scraped_at, canonical,
         first(category ORDER BY confidence DESC, rule_ord) AS category, max(confidence) AS confidence,
         first(source ORDER BY confidence DESC, rule_ord) AS sources, 0 AS job_mention_count,
         CAST(0 AS DOUBLE) AS job_mention_frequency, 0 AS job_count,
         row_number() OVER (PARTITION BY domain, scraped_at ORDER BY min(rule_ord)) AS tech_ord
  FROM signal GROUP BY domain, scraped_at, canonical)
"""

LOG = """
log AS (
  SELECT event_id AS request_id, ts, 'key-' || user_id AS key_id, value AS ms,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status
  FROM events),
api_key AS (
  SELECT DISTINCT 'key-' || user_id AS key_id, CASE WHEN user_id % 2 = 0 THEN 'starter' ELSE 'pro' END AS plan,
         CASE WHEN user_id % 3 <> 0 THEN 1 END AS requests_per_minute, 55 + user_id % 10 AS monthly_limit,
         CASE WHEN user_id % 4 = 0 THEN 'old-' || user_id END AS customer,
         CASE WHEN user_id % 4 = 0 THEN 'oldsub-' || user_id END AS subscription
  FROM events)
"""

WINDOWS = """
minutes AS (
  SELECT key_id, date_trunc('minute', ts) AS window_start, count(*) AS requests FROM log GROUP BY ALL),
over AS (
  SELECT key_id, window_start, requests, CAST(coalesce(requests_per_minute, 60) AS BIGINT) AS allowed
  FROM minutes LEFT JOIN api_key USING (key_id)
  WHERE requests > coalesce(requests_per_minute, 60))
"""

ORACLES: dict[str, str] = {}

# -- sources --------------------------------------------------------------------------------

STRIP_TAGS = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"


def full_strip(expr: str) -> str:
    for element in ("style", "script"):
        expr = f"regexp_replace({expr}, '<{element}[^>]*>.*?</{element}>', '', 'gis')"
    expr = replaced(STRIP_TAGS.format(expr), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))
    return collapsed(f"regexp_replace({expr}, '&#[0-9]+;', ' ', 'g')")


def short_strip(expr: str) -> str:
    return collapsed(replaced(STRIP_TAGS.format(expr), ("&amp;", "&"), ("&nbsp;", " ")))


ORACLES["ingest_board_a"] = with_(TAXONOMY, DOCS) + f"""
, job AS (
  SELECT src || '.example.com' AS domain, src AS token, doc_id AS i, 0 AS pos, doc_id AS id,
         CASE WHEN doc_id % 5 <> 0 THEN 'Engineer ' || doc_id ELSE '' END AS title, text, lang
  FROM docs WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT src || '.example.com', src, doc_id, 1, doc_id + 1000000, 'Second', text, lang
  FROM docs WHERE doc_id % 10 BETWEEN 1 AND 4)
SELECT domain, CAST(id AS VARCHAR) AS posting_id, CAST(pos AS BIGINT) AS pos, title,
       md5({full_strip("'<style>p{x}</style><p>' || text || '</p>&amp;lt;b&nbsp; <b>' || alias || '</b>&#39;s'")}) AS description_md5,
       CASE WHEN i % 3 <> 0 THEN 'City ' || lang ELSE '' END AS location,
       CASE i % 4 WHEN 1 THEN 'Data' WHEN 2 THEN 'Web' ELSE '' END AS department, '' AS team,
       CASE WHEN i % 2 = 0 THEN 'https://jobs.example.com/' || i
            ELSE 'https://boards.greenhouse.io/' || token || '/jobs/' || id END AS url,
       CASE WHEN i % 6 <> 0 THEN {ts(day("i % 28"))} END AS posted_at
FROM job JOIN taxonomy ON alias_ord = (i * 13) % {N}
"""

ORACLES["ingest_board_b"] = with_(TAXONOMY, DOCS) + f"""
, part AS (
  SELECT doc_id AS i, 1 AS o, text AS part FROM docs
  UNION ALL SELECT doc_id, 2, 'We hire.' FROM docs WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 3, 'Requirements' FROM docs WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 4, {short_strip("'<li>' || alias || '</li>&amp;&nbsp;<li>x</li>'")}
            FROM docs JOIN taxonomy ON alias_ord = (doc_id * 13) % {N} WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 5, 'Extras' FROM docs WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 6, {short_strip("'<b>' || alias || '</b>'")}
            FROM docs JOIN taxonomy ON alias_ord = (doc_id * 31) % {N} WHERE doc_id % 5 <> 0 AND doc_id % 4 < 2),
described AS (SELECT i, string_agg(part, ' ' ORDER BY o) AS description FROM part WHERE part <> '' OR o IN (4, 6) GROUP BY i)
SELECT src || '.example.com' AS domain, 'b-' || doc_id AS posting_id, CAST(0 AS BIGINT) AS pos,
       CASE WHEN doc_id % 7 <> 0 THEN 'Developer ' || lang ELSE '' END AS title,
       md5(description) AS description_md5,
       CASE WHEN doc_id % 6 <> 0 THEN 'City ' || lang ELSE '' END AS location,
       CASE WHEN doc_id % 6 <> 0 AND doc_id % 2 = 0 THEN 'Data' ELSE '' END AS department,
       CASE WHEN doc_id % 6 <> 0 THEN 'Core' ELSE '' END AS team,
       CASE WHEN doc_id % 2 = 1 THEN 'https://jobs.example.com/b/' || doc_id
            ELSE 'https://jobs.lever.co/' || src || '/b-' || doc_id END AS url,
       CASE WHEN doc_id % 8 <> 0 THEN {ts(f"({DAY0} + to_seconds(doc_id))")} END AS posted_at
FROM docs JOIN described ON i = doc_id WHERE doc_id % 10 <> 9
"""

RESULT_PAGE = """
result_page AS (
  SELECT page_id,
         html || CASE WHEN page_id % 3 = 0 THEN
           '<h2 class="big jobTitle"><span><a href="/viewjob?n=' || page_id || '">Card ' || page_id
           || '</a></span></h2><div data-testid="job-title"><a href="https://jobs.example.com/c/' || page_id || '">Other</a></div>'
         ELSE
           '<a class="x" data-jk="k" href="/rc/clk?jk=ab' || page_id || '&amp;from=x"><b>Data</b> &amp; Web D&eacute;v &#233;&ndash;R&#x27;D &copy &amp;lt; ' || page_id
           || '</a><a id="job_1" href="https://jobs.example.com/v?jk=cd' || page_id || '"> Dev' || chr(10)
           || '</a><a id=''job_2'' href=''/nokey''>No key</a><a data-jk=''z'' href=''/rc/clk?jk=ef''>  </a>' END
         || CASE WHEN page_id % 2 = 0 THEN
           '<nav aria-label="pagination"><ul><li><a href="/jobs?start=' || page_id
           || '">1</a></li><li><a href="https://jobs.example.com/p"> 2 </a></li><li><a href="/next">Next</a></li></ul></nav>'
         ELSE '' END AS html
  FROM pages)
"""


def anchors(html: str, pattern: str, name: str) -> str:
    """Anchors inside what ``pattern`` matches, with address and text."""
    known = [("&eacute;", "é"), ("&#233;", "é"), ("&ndash;", "–"), ("&#x27;", "'"), ("&copy ", "© "), ("&amp;", "&")]
    text = trimmed(replaced("regexp_replace(a, '<[^>]*>', '', 'g')", *known))
    href = replaced("regexp_extract(a, 'href=[\"'']([^\"'']*)[\"'']', 1)", ("&amp;", "&"))
    return f"""
{name} AS (
  SELECT page_id, n, {href} AS href, {text} AS title
  FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS n
        FROM (SELECT page_id, regexp_extract_all({html}, '{pattern}', 0, 's') AS l FROM result_page)))
"""


ABSOLUTE = "CASE WHEN href LIKE 'http%' THEN href ELSE 'https://www.indeed.com' || href END"
KEYED = r"<a [^>]*(?:data-jk=|id=[\"'']job_)[^>]*>.*?</a>"
CARD = r'<a href="[^"]*">(?:Card [0-9]+|Other)</a>'
LINKS = [
    RESULT_PAGE,
    anchors("html", KEYED, "keyed_all"),
    anchors("html", CARD, "card"),
    f"""
keyed AS (
  SELECT page_id, n, {ABSOLUTE} AS url, title, regexp_extract(href, '[?&]jk=([a-z0-9]+)', 1, 'i') AS jk
  FROM keyed_all WHERE href <> '' AND title <> '' AND regexp_matches(href, '[?&]jk=[a-z0-9]+', 'i')),
link AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, url, title, jk
  FROM (SELECT page_id, n, url, title, jk FROM keyed
        UNION ALL
        SELECT page_id, n, {ABSOLUTE}, title, NULL FROM card c
        WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.page_id = c.page_id)))
""",
]
ORACLES["html_job_links"] = with_(*LINKS) + "SELECT page_id, pos, url, title, jk FROM link"

def plain(expr: str) -> str:
    """Character references as a browser reads them, also those without a semicolon."""
    for name, text in (("quot", '"'), ("#x27", "'"), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{name};?', {quoted(text)}, 'g')"
    return expr


UNSCRIPTED = "replace(html, 't=\"</p>\"', 't=\"' || chr(1) || '/p>\"')"
DETAIL = f"""
detail AS (
  SELECT page_id,
         CASE WHEN page_id % 3 = 0 THEN 'https://www.indeed.com/viewjob?n=' || page_id
              ELSE 'https://www.indeed.com/rc/clk?jk=ab' || page_id || '&from=x' END AS url,
         {trimmed(plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} AS title,
         'Co ' || page_id AS company,
         {collapsed(f"'Role ' || page_id || regexp_replace({plain(UNSCRIPTED)}, '<[^>]+>', '', 'g')")} AS marked
  FROM pages WHERE page_id % 4 <> 3)
"""
ORACLES["html_job_detail"] = with_(DETAIL) + """
SELECT page_id, url, title, company, md5(replace(marked, chr(1), '<')) AS description_md5 FROM detail
"""
ORACLES["html_job_postings"] = with_(*LINKS, DETAIL) + """
SELECT l.page_id, pos, coalesce(jk, url) AS posting_id, coalesce(nullif(d.title, ''), l.title) AS title,
       url, md5(replace(marked, chr(1), '<')) AS description_md5
FROM link l JOIN detail d USING (url)
"""

ORACLES["html_pagination"] = with_(
    RESULT_PAGE,
    anchors("regexp_extract(html, '<nav aria-label=\"pagination\">.*?</nav>', 0, 's')", "<a .*?</a>", "numbered"),
) + f"""
SELECT page_id, CAST(title AS BIGINT) AS page, {ABSOLUTE} AS url
FROM numbered WHERE regexp_full_match(title, '[0-9]+')
"""

ENCODED = replaced(
    "url_encode({0})", ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")
)
ORACLES["search_addresses"] = f"""
SELECT c_custkey, 'https://www.indeed.com/jobs?q=' || {ENCODED.format("'\"' || c_name || ' (R&D) & Söhne*''s!~+\"'")}
       || '&sc=0kf%3Aattr(DSQF7)%3B&sort=date&l=' || {ENCODED.format("c_mktsegment")} AS url
FROM customer
"""
ORACLES["registry_filter"] = with_(REGISTRY) + "SELECT * FROM registry WHERE board = 'lever'"

CAREER = """
career AS (
  SELECT page_id, html || CASE page_id % 4
    WHEN 0 THEN '<script src="https://boards.greenhouse.io/embed/job_board?for=acme-' || page_id
                || '"></script><a href="https://boards.greenhouse.io/jobs/Last_' || page_id || '">x</a>'
    WHEN 1 THEN 'see greenhouse.io/boards/raw' || page_id || ' or greenhouse.io/boards/two'
    WHEN 2 THEN '<p>https://jobs.lever.co/Lev-' || page_id || '/1 jobs.lever.co/second</p>'
    ELSE '<p>no board</p>' END AS html
  FROM pages)
"""
ORACLES["discover_token_a"] = with_(CAREER) + """
SELECT page_id, token FROM (
  SELECT page_id,
         coalesce(
           list_last(regexp_extract_all(html, '<(?:script|iframe|a) [^>]*greenhouse\\.io/(?:embed/job_board\\?for=|jobs/)([a-z0-9_-]+)', 1, 'i')),
           nullif(regexp_extract(html, 'greenhouse\\.io/(?:embed/job_board\\?for=|boards/)([a-z0-9_-]+)', 1, 'i'), '')) AS token
  FROM career)
WHERE token IS NOT NULL
"""
ORACLES["discover_token_b"] = with_(CAREER) + """
SELECT page_id, token FROM (
  SELECT page_id, nullif(regexp_extract(html, 'jobs\\.lever\\.co/([a-z0-9_-]+)', 1, 'i'), '') AS token FROM career)
WHERE token IS NOT NULL
"""

ORACLES["worklist"] = with_(REGISTRY) + """
SELECT board || ':' || domain AS task, board AS source, domain, company_name, token FROM registry
UNION ALL
SELECT 'html_headers:' || domain, 'html_headers', domain,
       first(company_name ORDER BY board, ord), NULL
FROM registry GROUP BY domain
"""
ORACLES["registry_dedupe"] = with_(REGISTRY) + """
SELECT * FROM registry r
WHERE NOT EXISTS (SELECT 1 FROM registry o WHERE o.domain = r.domain AND o.ord < r.ord)
"""

# -- text -----------------------------------------------------------------------------------

MARKED = """
marked AS (
  SELECT page_id, html || '<SCRIPT type=''x''>var a = ''<b>'';</SCRIPT> &nbsp;R&amp;D &amp;lt;b&gt; it&#39;s '
         || chr(10) || ' x' || page_id || chr(10) || chr(65279) || ' <p>end</p>' || chr(12288) AS html
  FROM pages)
"""
for mode, strip in (("full", full_strip), ("short", short_strip)):
    ORACLES[f"strip_html_{mode}"] = with_(MARKED) + f"""
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {strip("html")} AS t FROM marked)
"""

ORACLES["extract_mentions"] = ORACLES["extract_mentions_anchor"] = with_(*MENTIONS) + """
SELECT posting_id, domain, source, canonical, category, raw_mention, alias_ord FROM mention
"""
ORACLES["extract_words"] = with_(
    f"words(canonical, category, alias, alias_ord) AS ({values(WORDS)})",
    "doc AS (SELECT doc_id AS posting_id, lower(text) AS low FROM documents)",
    hits("doc", "words", "posting_id"),
) + "SELECT posting_id, canonical, category, raw_mention, alias_ord FROM mention"

ORACLES["alias_map"] = with_(TAXONOMY, AMAP, f"""
written AS (
  SELECT alias, count(*) AS n
  FROM (SELECT (doc_id * 13) % {N} AS o FROM documents UNION ALL SELECT (doc_id * 31) % {N} FROM documents)
  JOIN taxonomy ON alias_ord = o GROUP BY alias)
""") + "SELECT alias, n, canonical, category, alias_ord FROM written JOIN amap USING (alias)"

ORACLES["valid_domain"] = """
SELECT page_id, lower(d) AS domain FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '-' || h WHEN 1 THEN upper(h) WHEN 2 THEN h || chr(10)
                  WHEN 3 THEN replace(h, '.', '_') ELSE h END AS d
  FROM (SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS h FROM pages))
WHERE length(d) BETWEEN 3 AND 253 AND regexp_full_match(d, '[a-zA-Z0-9][a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')
"""

# -- headers --------------------------------------------------------------------------------

ORACLES["header_signals"] = with_(CAPTURE) + """
SELECT domain, rule_ord, canonical, category, confidence, source FROM header_signal
"""
ORACLES["meta_generator_signals"] = with_(CAPTURE) + """
SELECT domain, generator, rule_ord, canonical, category, confidence, source FROM generator_signal
"""
ORACLES["header_profile"] = with_(CAPTURE) + """
SELECT domain, canonical, category, confidence, sources, tech_ord FROM header_pt
"""

# -- profiles -------------------------------------------------------------------------------

SCRAPE = f"domain, source, {ts('scraped_at')} AS scraped_at"

ORACLES["mention_rollup"] = with_(*MENTIONS) + f"""
SELECT {SCRAPE}, canonical, category, posting_count, raw_mention,
       row_number() OVER (PARTITION BY domain, source, scraped_at ORDER BY posting_count DESC, p, o) AS rank FROM (
  SELECT domain, source, scraped_at, canonical, category, count(*) AS posting_count,
         arg_min(raw_mention, pos) AS raw_mention, min(pos) AS p, arg_min(alias_ord, pos) AS o
  FROM mention GROUP BY domain, source, scraped_at, canonical, category)
"""

ORACLES["score_signals"] = with_(TAXONOMY, DOCS, f"""
signal AS (
  SELECT src || '.example.com' AS domain, doc_id AS g, p,
         CASE (k * 7 + sn) % 6 WHEN 0 THEN 'job_listing' WHEN 1 THEN 'html_headers' WHEN 2 THEN 'github_org'
           WHEN 3 THEN 'g2_profile' WHEN 4 THEN 'linkedin' ELSE 'press' END AS source,
         canonical, category, alias
  FROM (SELECT *, 0 AS p, (doc_id * 13) % {N} AS o FROM docs
        UNION ALL SELECT *, 1, (doc_id * 31) % {N} FROM docs)
  JOIN taxonomy ON alias_ord = o),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY domain, canonical, source ORDER BY g, p) AS nth,
         row_number() OVER (PARTITION BY domain, canonical ORDER BY g, p) AS arrival
  FROM signal)
""") + """
SELECT domain, canonical, arg_min(category, arrival) AS category,
       round(least(0.99, CASE arg_min(source, arrival) WHEN 'job_listing' THEN 0.7 WHEN 'html_headers' THEN 0.95
         WHEN 'github_org' THEN 0.85 WHEN 'g2_profile' THEN 0.6 WHEN 'linkedin' THEN 0.55 ELSE 0.5 END
         + 0.05 * (count(*) - 1)), 4)::DOUBLE AS confidence,
       string_agg(source, '|' ORDER BY arrival) AS sources, string_agg(alias, '|' ORDER BY arrival) AS raw_mentions,
       row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, min((g, p)), canonical) AS rank
FROM numbered WHERE nth = 1 GROUP BY domain, canonical
"""

ORACLES["tech_profile_large"] = ORACLES["tech_profile"] = with_(*PROFILES) + f"""
SELECT {SCRAPE}, canonical, category, confidence, sources, job_mention_count, job_mention_frequency,
       job_count, tech_ord FROM pt
"""
ORACLES["by_category"] = with_(*PROFILES) + f"""
SELECT {SCRAPE}, category, string_agg(canonical, '|' ORDER BY tech_ord) AS technologies
FROM pt GROUP BY pt.domain, pt.source, pt.scraped_at, category
"""
ORACLES["top_tech"] = with_(*PROFILES) + f"""
SELECT {SCRAPE}, rank, canonical, floor(confidence * 100 + 0.5) / 100 AS confidence, job_mention_count
FROM (SELECT *, row_number() OVER (PARTITION BY domain, source, scraped_at ORDER BY confidence DESC, tech_ord) AS rank FROM pt)
WHERE rank <= 15
"""
ORACLES["profile_totals"] = with_(*SNAPSHOTS) + """
SELECT count(*) AS profiles, CAST(sum(tech_count) AS BIGINT) AS tech_signals FROM snap
"""
QUIET = f"""
quiet AS (
  SELECT c_name AS name, replace(lower(c_name), '#', '-') || '.example.com' AS domain, 'lever' AS source,
         {day("c_custkey % 5")} AS scraped_at, 2 AS job_count
  FROM customer WHERE c_custkey % 50 = 0)
"""
ORACLES["run_totals"] = with_(*SNAPSHOTS, QUIET) + """
SELECT count(*) AS total_companies, CAST(sum(job_count) AS BIGINT) AS total_jobs
FROM (SELECT job_count FROM snap UNION ALL SELECT job_count FROM quiet)
"""
ORACLES["merge_profiles"] = with_(*PROFILES, merged("pt", "m")) + f"""
SELECT domain, canonical, category, confidence, sources, job_mention_count, job_mention_frequency,
       {ts("last_scraped")} AS last_scraped FROM m
"""
FLAT_SNAP = f"{SCRAPE}, job_count, tech_count, technologies"
ORACLES["latest_profile"] = with_(*SNAPSHOTS) + f"SELECT {FLAT_SNAP} FROM latest"
ORACLES["latest_by_source"] = with_(*SNAPSHOTS) + f"SELECT {FLAT_SNAP} FROM current_by_source"
ORACLES["profiles_by_source"] = with_(*SNAPSHOTS) + f"""
SELECT {FLAT_SNAP} FROM snap WHERE source IN ('lever', 'indeed')
"""

# -- company queries ------------------------------------------------------------------------

ENTRY = "canonical || ':' || printf('%.2f', confidence)"


def by_category(table: str, keys: str, order: str, name: str) -> str:
    """``category=a,b;...`` per key, categories sorted."""
    return f"""
{name} AS (
  SELECT {keys}, string_agg(category || '=' || l, ';' ORDER BY category) AS by_category
  FROM (SELECT {keys}, category, string_agg(canonical, ',' ORDER BY {order}) AS l
        FROM {table} GROUP BY {keys}, category) GROUP BY {keys})
"""


ORACLES["company_detail"] = with_(
    *EVENTS, COMPANY, merged("pt", "m"),
    "shown AS (SELECT * FROM m WHERE confidence >= 0.75)",
    by_category("shown", "domain", "confidence DESC, first_age, first_ord", "cats"),
    f"""
listed AS (
  SELECT domain, count(*) AS tech_count,
         string_agg({ENTRY}, '|' ORDER BY confidence DESC, first_age, first_ord) AS technologies
  FROM shown GROUP BY domain),
sources AS (
  SELECT domain, max(scraped_at) AS last_scraped,
         string_agg(source, '|' ORDER BY scraped_at DESC, source) AS sources_available
  FROM m_age GROUP BY domain),
history AS (
  SELECT domain, count(*) AS history_size, string_agg(event_type || ':' || canonical, '|' ORDER BY rn) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY canonical, event_type, source) AS rn FROM event)
  GROUP BY domain)
""") + f"""
SELECT domain, name AS company, {ts("last_scraped")} AS last_scraped, sources_available,
       coalesce(tech_count, 0) AS tech_count, coalesce(technologies, '') AS technologies,
       coalesce(by_category, '') AS by_category, coalesce(history_size, 0) AS history_size,
       coalesce(history, '') AS history
FROM company JOIN sources USING (domain) LEFT JOIN listed USING (domain) LEFT JOIN cats USING (domain)
LEFT JOIN history USING (domain)
"""

ORACLES["company_detail_category"] = with_(*PROFILES, COMPANY, merged("pt", "m")) + f"""
SELECT domain, count(canonical) AS tech_count,
       coalesce(string_agg({ENTRY}, '|' ORDER BY confidence DESC, first_age, first_ord), '') AS technologies
FROM company SEMI JOIN pt USING (domain)
LEFT JOIN (SELECT * FROM m WHERE category = 'language') l USING (domain)
GROUP BY domain
"""

LISTED = """
stats AS (
  SELECT domain, count(*) AS source_count, max(scraped_at) AS last_scraped FROM current_by_source GROUP BY domain),
chosen AS (
  SELECT * FROM company WHERE lower(domain) LIKE '%{q}%' OR lower(name) LIKE '%{q}%')
"""
ORACLES["company_list"] = with_(*SNAPSHOTS, COMPANY, LISTED.format(q="c_%0")) + f"""
SELECT domain, name, {ts("created_at")} AS created_at, {ts("updated_at")} AS updated_at,
       coalesce(source_count, 0) AS source_count, {ts("last_scraped")} AS last_scraped
FROM (SELECT * FROM chosen ORDER BY updated_at DESC NULLS FIRST, domain LIMIT 40 OFFSET 40)
LEFT JOIN stats USING (domain)
"""
ORACLES["company_list_profiled"] = with_(*SNAPSHOTS, COMPANY, LISTED.format(q="src")) + f"""
SELECT domain, name, coalesce(source_count, 0) AS source_count, {ts("last_scraped")} AS last_scraped
FROM (SELECT * FROM chosen ORDER BY name NULLS LAST, domain LIMIT 25)
LEFT JOIN stats USING (domain)
"""
PAGE_TOTALS = """
SELECT CAST({page} AS BIGINT) AS page, CAST({size} AS BIGINT) AS per_page, total,
       CAST(ceil(total / {size}) AS BIGINT) AS total_pages, {page} * {size} < total AS has_next
FROM (SELECT count(*) AS total FROM {table})
"""
ORACLES["company_list_page"] = with_(*SNAPSHOTS, COMPANY, LISTED.format(q="c_%0")) + PAGE_TOTALS.format(
    page=2, size=40, table="chosen"
)


def domains_with(condition: str) -> str:
    return f"(SELECT domain FROM latest_tech WHERE {condition})"


def found(*conditions: str) -> str:
    return f"SELECT {SCRAPE} FROM latest WHERE " + " AND ".join(conditions)


HAS_ANY = f"domain IN {domains_with(f'canonical IN ({names(USES_ANY)}) AND confidence >= 0.6')}"
ORACLES["search_uses_all"] = with_(*SNAPSHOTS) + f"""
SELECT {SCRAPE} FROM latest WHERE domain IN (
  SELECT domain FROM latest_tech WHERE canonical IN ('React', 'JavaScript') AND confidence >= 0.6
  GROUP BY domain HAVING count(DISTINCT canonical) = 2)
"""
ORACLES["search_uses_any"] = with_(*SNAPSHOTS) + found(HAS_ANY)
ORACLES["search_excludes"] = with_(*SNAPSHOTS) + found(
    f"domain NOT IN {domains_with(f'canonical IN ({names(EXCLUDES)})')}"
)
ORACLES["search_category"] = with_(*SNAPSHOTS) + found(
    "domain IN " + domains_with("category = 'payments' AND confidence >= 0.6")
)
ORACLES["search_count"] = with_(*SNAPSHOTS) + f"SELECT count(*) AS total FROM latest WHERE {HAS_ANY}"
ORACLES["search_matched"] = with_(*SNAPSHOTS) + f"""
SELECT {SCRAPE}, coalesce(matched, '') AS matched FROM snap LEFT JOIN (
  SELECT domain, source, scraped_at, string_agg({ENTRY}, '|' ORDER BY tech_ord) AS matched
  FROM pt WHERE canonical IN ({names([*USES, *USES_ANY])}) AND confidence >= 0.6
  GROUP BY domain, source, scraped_at) USING (domain, source, scraped_at)
"""

TARGETS = names([*USES_ANY, *USES])
SEARCHED = f"""
searched AS (
  SELECT l.*, c.name FROM latest l JOIN company c USING (domain)
  WHERE domain IN {domains_with(f"canonical IN ({TARGETS}) AND confidence >= 0.6")}
    AND domain NOT IN {domains_with(f"canonical IN ({names(EXCLUDES[:1])})")}
    AND domain IN {domains_with("category = 'language' AND confidence >= 0.6")})
"""
ORACLES["search_stack"] = with_(*SNAPSHOTS, COMPANY, SEARCHED) + f"""
SELECT s.domain, s.name, {ts("s.scraped_at")} AS last_scraped, s.job_count,
       (SELECT string_agg({ENTRY}, '|' ORDER BY tech_ord) FROM latest_tech t
        WHERE t.domain = s.domain AND canonical IN ({TARGETS}) AND confidence >= 0.6) AS matched_technologies
FROM searched s ORDER BY s.scraped_at DESC, s.domain LIMIT 25
"""
ORACLES["search_page"] = with_(*SNAPSHOTS, COMPANY, SEARCHED) + PAGE_TOTALS.format(page=2, size=3, table="searched")
ORACLES["search_second_page"] = with_(*SNAPSHOTS, COMPANY, SEARCHED) + f"""
SELECT domain, name, {ts("scraped_at")} AS last_scraped FROM searched ORDER BY scraped_at DESC, domain LIMIT 3 OFFSET 3
"""
ORACLES["example_uses"] = with_(*SNAPSHOTS) + f"""
SELECT {SCRAPE}, first_entry, own_entry FROM (
  SELECT domain, source, scraped_at,
         bool_or(canonical = 'React') AND bool_or(tech_ord = 1 AND confidence > 0.69) AS first_entry,
         bool_or(canonical = 'React' AND confidence >= 0.69) AS own_entry
  FROM pt GROUP BY domain, source, scraped_at)
WHERE first_entry OR own_entry
"""

# -- report, export -------------------------------------------------------------------------

ORACLES["run_report"] = with_(
    *SNAPSHOTS, COMPANY, by_category("pt", "domain, source, scraped_at", "tech_ord", "cats"), QUIET, f"""
top AS (
  SELECT domain, source, scraped_at, string_agg({ENTRY}, '|' ORDER BY tech_ord) AS tech_profile,
         string_agg(canonical || ':' || category || ':' || printf('%.2f', confidence) || ':' || job_mention_count, '|'
                    ORDER BY tech_ord) FILTER (WHERE tech_ord <= 15) AS top_tech
  FROM pt GROUP BY domain, source, scraped_at)
""") + f"""
SELECT name AS company_name, {SCRAPE}, job_count, tech_count, tech_profile, by_category, top_tech
FROM snap JOIN company USING (domain) JOIN cats USING (domain, source, scraped_at) JOIN top USING (domain, source, scraped_at)
UNION ALL
SELECT name, {SCRAPE}, job_count, 0, '', '', '' FROM quiet
"""

EXPORT = [
    *SNAPSHOTS, COMPANY, by_category("latest_tech", "domain", "tech_ord", "cats"),
    """
exported AS (
  SELECT domain, name, replace(technologies, '|', ', ') AS technologies, by_category AS categories,
         scraped_at, job_count
  FROM latest JOIN company USING (domain) JOIN cats USING (domain))
"""]
EXPORT_ORDER = "ORDER BY scraped_at DESC, domain"
ORACLES["export_json"] = with_(*EXPORT) + f"""
SELECT domain, name, technologies, categories, {ts("scraped_at")} AS last_scraped, job_count FROM exported
WHERE domain IN {domains_with("canonical = 'Python' AND confidence >= 0.6")} {EXPORT_ORDER}
"""
ORACLES["export_domains"] = with_(*EXPORT) + f"""
SELECT domain, job_count FROM exported
WHERE domain IN ({names([f"src{n}.example.com" for n in range(0, 30, 3)])}) {EXPORT_ORDER}
"""
ORACLES["export_category"] = with_(*EXPORT) + f"""
SELECT domain, technologies FROM exported
WHERE domain IN {domains_with("category = 'payments' AND confidence >= 0.6")} {EXPORT_ORDER}
"""
ORACLES["export_csv"] = with_(*EXPORT, """
first_seen AS (
  SELECT domain, '{' || string_agg('"' || category || '":[' || l || ']', ',' ORDER BY o) || '}' AS j
  FROM (SELECT domain, category, min(tech_ord) AS o,
               string_agg('"' || canonical || '"', ',' ORDER BY tech_ord) AS l
        FROM latest_tech GROUP BY domain, category) GROUP BY domain)
""") + f"""
SELECT domain || ',' || name || ',' ||
       CASE WHEN contains(technologies, ',') THEN '"' || technologies || '"' ELSE technologies END || ',' ||
       '"' || replace(j, '"', '""') || '",' || strftime(scraped_at, '%Y-%m-%dT%H:%M:%S.000Z') AS line
FROM exported JOIN first_seen USING (domain) {EXPORT_ORDER}
"""

# -- changes and upserts --------------------------------------------------------------------

ORACLES["change_events"] = with_(*EVENTS) + f"SELECT {EVENT_COLUMNS} FROM event"
ORACLES["change_history"] = with_(*EVENTS) + """
SELECT domain, rank, event_type, canonical, source FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY canonical, event_type, source) AS rank FROM event)
"""
ORACLES["recent_adopters"] = with_(*EVENTS) + """
SELECT domain, source FROM event WHERE canonical = 'Kubernetes' AND event_type = 'added'
ORDER BY domain, source LIMIT 100
"""
ORACLES["confidence_changes"] = with_(
    *PROFILES, VERSIONS, merged("old_pt", "om"), merged("new_pt", "nm")
) + f"""
SELECT domain, 'merged' AS source, 'confidence_change' AS event_type, canonical, n.category AS category,
       o.confidence AS old_confidence, n.confidence AS new_confidence, {ts(NOW)} AS detected_at
FROM om o JOIN nm n USING (domain, canonical) WHERE o.confidence <> n.confidence
"""
ORACLES["change_stream"] = with_(*EVENTS) + f"""
SELECT domain, source, 'added' AS event_type, canonical, category, CAST(NULL AS DOUBLE) AS old_confidence,
       confidence AS new_confidence, {ts("scraped_at")} AS detected_at
FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt o WHERE o.domain = p.domain AND o.source = p.source
                            AND o.scraped_at < p.scraped_at)
UNION ALL
SELECT e.domain, e.source, event_type, canonical, category, old_confidence, new_confidence, {ts("s.scraped_at")}
FROM event e JOIN (SELECT DISTINCT domain, source, scraped_at FROM new_pt) s USING (domain, source)
WHERE EXISTS (SELECT 1 FROM old_pt o WHERE o.domain = e.domain AND o.source = e.source)
"""

ORACLES["upsert_company"] = with_(COMPANY, REGISTRY, """
batch AS (
  SELECT source || '.example.com' AS domain, upper(source) || ' Inc' AS name FROM documents
  UNION
  SELECT domain, arg_max(company_name, ord) FROM registry GROUP BY domain)
""") + f"""
SELECT domain, coalesce(b.name, c.name) AS name, {ts(f"coalesce(c.created_at, {NOW})")} AS created_at,
       {ts(f"CASE WHEN b.name IS NOT NULL THEN {NOW} ELSE c.updated_at END")} AS updated_at
FROM company c FULL JOIN batch b USING (domain)
"""
ORACLES["upsert_profile"] = with_(*SNAPSHOTS, CAPTURE, f"""
stored AS (
  SELECT * FROM snap WHERE scraped_at < {SPLIT}
  UNION ALL
  SELECT domain, source, scraped_at, 0, count(*), string_agg(canonical, '|' ORDER BY tech_ord)
  FROM header_pt GROUP BY domain, source, scraped_at),
batch AS (SELECT * FROM snap WHERE scraped_at >= {SPLIT})
""") + f"""
SELECT {FLAT_SNAP}, {ts(f"CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.domain = b.domain AND s.source = b.source) THEN {DAY0} ELSE {NOW} END")} AS created_at,
       {ts(NOW)} AS updated_at
FROM batch b
UNION ALL
SELECT {FLAT_SNAP}, {ts(DAY0)}, {ts(DAY0)} FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.domain = s.domain AND b.source = s.source)
"""
ORACLES["refresh"] = with_(*PROFILES, VERSIONS, CAPTURE, """
fresh AS (
  SELECT domain, source, canonical, category, confidence FROM new_pt
  UNION ALL SELECT domain, source, canonical, category, confidence FROM header_pt)
""", diff("old_pt", "fresh")) + f"SELECT {EVENT_COLUMNS} FROM event"

STORED = f"""
first_run AS (SELECT * FROM snap WHERE scraped_at < {SPLIT}),
second_run AS (
  SELECT * FROM snap WHERE scraped_at >= {SPLIT}
  UNION ALL
  SELECT domain, source, scraped_at, 0, count(*), string_agg(canonical, '|' ORDER BY tech_ord)
  FROM header_pt GROUP BY domain, source, scraped_at)
"""
ORACLES["refresh_companies"] = with_(*SNAPSHOTS, CAPTURE, STORED) + f"""
SELECT domain, CASE WHEN domain LIKE 'site%' THEN replace(replace(domain, 'site', 'Site '), '.example.com', '')
                    ELSE upper(replace(domain, '.example.com', '')) END AS name,
       {ts(f"CASE WHEN domain IN (SELECT domain FROM first_run) THEN {SPLIT} ELSE {NOW} END")} AS created_at,
       {ts(f"CASE WHEN domain IN (SELECT domain FROM second_run) THEN {NOW} ELSE {SPLIT} END")} AS updated_at
FROM (SELECT domain FROM first_run UNION SELECT domain FROM second_run)
"""
ORACLES["refresh_profiles"] = with_(*PROFILES, VERSIONS, SNAPSHOT, CAPTURE, STORED, """
fresh AS (
  SELECT domain, source, canonical, category, confidence FROM new_pt
  UNION ALL SELECT domain, source, canonical, category, confidence FROM header_pt)
""", diff("old_pt", "fresh"), f"""
logged AS (
  SELECT domain, source, count(*) AS events FROM (
    SELECT domain, source FROM event UNION ALL SELECT domain, source FROM old_pt) GROUP BY domain, source),
both_runs AS (
  SELECT *, {NOW} AS updated FROM second_run
  UNION ALL
  SELECT *, {SPLIT} FROM first_run f
  WHERE NOT EXISTS (SELECT 1 FROM second_run s WHERE s.domain = f.domain AND s.source = f.source))
""") + f"""
SELECT {FLAT_SNAP}, {ts(f"CASE WHEN (domain, source) IN (SELECT (domain, source) FROM first_run) THEN {SPLIT} ELSE {NOW} END")} AS created_at,
       {ts("updated")} AS updated_at, events
FROM both_runs LEFT JOIN logged USING (domain, source)
"""

# -- usage ----------------------------------------------------------------------------------

ORACLES["monthly_usage"] = with_(LOG, """
every_key AS (
  SELECT key_id, monthly_limit, CAST(substr(key_id, 5) AS BIGINT) % 7 <> 0 AS is_active FROM api_key
  UNION ALL
  SELECT 'idle-' || c_custkey, CASE WHEN c_custkey % 100 <> 0 THEN 50 END, true FROM customer WHERE c_custkey % 50 = 0),
accepted AS (
  SELECT key_id, monthly_limit, ts, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM (
    SELECT *, row_number() OVER (PARTITION BY key_id, date_trunc('month', ts) ORDER BY ts, request_id) AS n
    FROM log JOIN every_key USING (key_id) WHERE is_active)
  WHERE n <= monthly_limit)
""") + f"""
SELECT key_id, {ts("month")} AS month, requests, monthly_limit,
       CASE WHEN monthly_limit IS NOT NULL THEN greatest(0, monthly_limit - requests) END AS remaining,
       {ts("month + INTERVAL 1 MONTH")} AS reset_at, {ts("last_used_at")} AS last_used_at
FROM (SELECT key_id, month, monthly_limit, count(ts) AS requests, max(ts) AS last_used_at
      FROM (SELECT key_id, month, monthly_limit FROM accepted
            UNION SELECT key_id, date_trunc('month', {NOW}), monthly_limit FROM every_key)
      LEFT JOIN accepted USING (key_id, month, monthly_limit) GROUP BY ALL)
"""
ORACLES["quota_breach"] = with_(LOG) + f"""
SELECT request_id, key_id, {ts("ts")} AS ts, monthly_limit FROM (
  SELECT *, row_number() OVER (PARTITION BY key_id, date_trunc('month', ts) ORDER BY ts, request_id) AS n
  FROM log JOIN api_key USING (key_id))
WHERE n > monthly_limit
"""
FLAT_WINDOW = f"key_id, {ts('window_start')} AS window_start, requests, allowed, requests - allowed AS refused"
ORACLES["rate_windows"] = with_(LOG, WINDOWS) + f"SELECT {FLAT_WINDOW} FROM over"
ORACLES["rate_stream"] = with_(LOG, WINDOWS) + f"""
SELECT {FLAT_WINDOW} FROM over
WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log)
"""
ORACLES["request_stats"] = with_(LOG) + """
SELECT key_id, count(*) AS requests, count(*) FILTER (WHERE status < 400) AS succeeded,
       count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors,
       count(*) FILTER (WHERE status >= 500) AS server_errors, round(sum(ms), 2) AS total_ms,
       max(ms) AS max_ms, quantile_disc(ms, 0.95) AS p95_ms
FROM log GROUP BY key_id
"""
ORACLES["plan_state"] = with_(LOG, f"""
billing AS (
  SELECT event_id AS seq, 'key-' || user_id AS key_id,
         CASE event_type WHEN 'signup' THEN '{COMPLETED}' WHEN 'purchase' THEN '{UPDATED}'
              WHEN 'error' THEN '{DELETED}' ELSE 'other' END AS type,
         CASE event_id % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' END AS plan,
         event_id % 3 <> 0 AS active,
         CASE WHEN event_id % 9 <> 0 THEN 'cus-' || event_id END AS customer, 'sub-' || event_id AS subscription
  FROM events WHERE event_id % 11 <> 0),
p AS (
  SELECT DISTINCT ON (key_id) key_id, CASE WHEN type = '{DELETED}' THEN 'starter' ELSE plan END AS plan
  FROM billing
  WHERE type = '{DELETED}' OR (plan IS NOT NULL AND (type = '{COMPLETED}' OR (type = '{UPDATED}' AND active)))
  ORDER BY key_id, seq DESC),
c AS (
  SELECT DISTINCT ON (key_id) key_id, customer FROM billing
  WHERE type = '{COMPLETED}' AND plan IS NOT NULL ORDER BY key_id, seq DESC),
s AS (
  SELECT DISTINCT ON (key_id) key_id, CASE WHEN type = '{COMPLETED}' THEN subscription END AS subscription
  FROM billing
  WHERE type = '{DELETED}' OR (type = '{COMPLETED}' AND plan IS NOT NULL) ORDER BY key_id, seq DESC)
""") + """
SELECT k.key_id, coalesce(p.plan, k.plan) AS plan,
       CASE p.plan WHEN 'starter' THEN 60 WHEN 'pro' THEN 300 WHEN 'enterprise' THEN 1000
            ELSE k.requests_per_minute END::BIGINT AS requests_per_minute,
       CASE p.plan WHEN 'starter' THEN 1000 WHEN 'pro' THEN 10000 WHEN 'enterprise' THEN 999999999
            ELSE k.monthly_limit END AS monthly_limit,
       CASE WHEN c.key_id IS NOT NULL THEN c.customer ELSE k.customer END AS customer,
       CASE WHEN s.key_id IS NOT NULL THEN s.subscription ELSE k.subscription END AS subscription
FROM api_key k LEFT JOIN p ON p.key_id = k.key_id LEFT JOIN c ON c.key_id = k.key_id LEFT JOIN s ON s.key_id = k.key_id
"""
ORACLES["key_hashes"] = with_(LOG) + "SELECT key_id, sha256(key_id) AS key_hash FROM api_key"
ORACLES["webhook_outbox"] = with_(*EVENTS, """
sub AS (
  SELECT 'sub-' || c_custkey AS id, 'https://hooks.example.com/' || c_custkey AS url, c_custkey % 3 AS kind,
         c_nationkey = 7 AND c_mktsegment = 'BUILDING' AS everywhere,
         'src' || (c_custkey % 20) || '.example.com' AS d1, 'src' || (c_custkey * 3 % 20) || '.example.com' AS d2
  FROM customer WHERE c_mktsegment <> 'MACHINERY')
""") + """
SELECT id AS subscription_id, url AS target, 'tech_' || event_type AS event, domain, source, canonical, category,
       coalesce(new_confidence, old_confidence) AS confidence,
       md5('{"event":"tech_' || event_type || '","domain":"' || domain || '","canonical":"' || canonical
           || '","category":"' || category || '","confidence":0.7,"detected_at":"2024-02-01T00:00:00.000Z"}') AS payload_md5
FROM event JOIN sub
  ON (everywhere OR domain = d1 OR domain = d2)
 AND ((event_type = 'added' AND kind IN (0, 2)) OR (event_type = 'removed' AND kind IN (1, 2)))
"""
ORACLES["outbox_stream"] = ORACLES["webhook_outbox"]
ORACLES["delivery_health"] = with_("""
log AS (SELECT 'sub-' || user_id AS subscription_id, ts, event_type <> 'error' AS ok FROM events),
good AS (SELECT subscription_id, max(ts) AS ok_ts FROM log WHERE ok GROUP BY subscription_id)
""") + f"""
SELECT subscription_id, {ts("max(ok_ts)")} AS last_fired_at,
       count(*) FILTER (WHERE NOT ok AND (ok_ts IS NULL OR ts > ok_ts)) AS failure_count
FROM log LEFT JOIN good USING (subscription_id) GROUP BY subscription_id
"""

TASKS = f"""
task AS (
  SELECT CASE c_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'html_headers' END AS run_type,
         c_name AS company,
         CASE WHEN c_custkey % 13 = 0 THEN 'fail' WHEN c_custkey % 7 = 0 THEN 'skip' ELSE 'ok' END AS status,
         {day("c_custkey % 3")} AS started_at, {day("c_custkey % 3 + 1")} AS completed_at
  FROM customer)
"""
ORACLES["run_summary"] = with_(TASKS) + f"""
SELECT run_type, count(*) AS attempted, count(*) FILTER (WHERE status = 'ok') AS succeeded,
       count(*) FILTER (WHERE status = 'skip') AS skipped, count(*) FILTER (WHERE status = 'fail') AS failed,
       {ts("min(started_at)")} AS started_at, {ts("max(completed_at)")} AS completed_at
FROM task GROUP BY run_type
"""
ORACLES["run_errors"] = with_(TASKS) + """
SELECT run_type, company, 'timeout ' || company AS error FROM task WHERE status = 'fail'
"""

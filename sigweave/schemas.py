"""Explicit schemas; nothing is inferred."""

PAYLOAD_A = """
    domain string, company_name string, token string, scraped_at timestamp,
    jobs array<struct<id: bigint, title: string, content: string, location: struct<name: string>,
        departments: array<struct<name: string>>, absolute_url: string, updated_at: string>>
"""

PAYLOAD_B = """
    domain string, company_name string, slug string, scraped_at timestamp,
    postings array<struct<id: string, text: string, descriptionPlain: string,
        additionalPlain: string, lists: array<struct<text: string, content: string>>,
        categories: struct<location: string, department: string, team: string>,
        hostedUrl: string, createdAt: bigint>>
"""

# What the second board's endpoint itself returns: a bare array, one posting a row.
POSTING_B = """
    id string, text string, descriptionPlain string, additionalPlain string,
    lists array<struct<text: string, content: string>>,
    categories struct<location: string, department: string, team: string>,
    hostedUrl string, createdAt bigint
"""

PROFILE_ENTRY = (
    "struct<canonical: string, category: string, confidence: double, sources: array<string>,"
    " job_mention_count: int, job_mention_frequency: double>"
)

SNAPSHOT = (
    "domain string, source string, scraped_at timestamp, job_count int, tech_count int,"
    f" tech_profile array<{PROFILE_ENTRY}>"
)

STORED_PROFILE = f"{SNAPSHOT}, created_at timestamp, updated_at timestamp"

COMPANY = "domain string, name string, created_at timestamp, updated_at timestamp"

CHANGE_EVENT = (
    "domain string, source string, event_type string, canonical string, category string,"
    " old_confidence double, new_confidence double, detected_at timestamp"
)

REQUEST_LOG = "ts timestamp, key_id string, url string, status int, ms double"

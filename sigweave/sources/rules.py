"""Rule tables for header and page signals; small, fixed, and always a parameter."""

from __future__ import annotations

from typing import NamedTuple


class HeaderRule(NamedTuple):
    header: str
    pattern: str
    canonical: str
    category: str


class GeneratorRule(NamedTuple):
    pattern: str
    canonical: str
    category: str


# Header | pattern (case-insensitive) | technology | category, in rule order.
_HEADER_RULES = r"""
server | nginx | Nginx | infrastructure
server | apache | Apache | infrastructure
server | caddy | Caddy | infrastructure
server | cloudflare | Cloudflare | infrastructure
server | fastly | Fastly | infrastructure
server | envoy | Envoy | infrastructure
server | istio | Istio | devops
server | openresty | OpenResty | infrastructure
server | microsoft-iis | IIS | infrastructure
server | lighttpd | Lighttpd | infrastructure
x-powered-by | php | PHP | language
x-powered-by | express | Express.js | backend
x-powered-by | next\.js | Next.js | frontend
x-powered-by | asp\.net | C# | language
x-powered-by | rails | Ruby on Rails | backend
x-powered-by | django | Django | backend
x-powered-by | fastapi | FastAPI | backend
x-powered-by | flask | Flask | backend
x-powered-by | wordpress | WordPress | cms
x-generator | wordpress | WordPress | cms
x-generator | drupal | Drupal | cms
x-generator | joomla | Joomla | cms
x-served-by | fastly | Fastly | infrastructure
via | cloudfront | AWS CloudFront | cloud
via | varnish | Varnish | infrastructure
cf-ray | .+ | Cloudflare | infrastructure
x-vercel-id | .+ | Vercel | cloud
x-netlify | .+ | Netlify | cloud
x-request-id | heroku | Heroku | cloud
x-amz-request-id | .+ | AWS | cloud
x-amzn-requestid | .+ | AWS | cloud
x-envoy-upstream-service-time | .+ | Envoy | infrastructure
"""

# Pattern (case-insensitive) on the generator tag | technology | category.
_GENERATOR_RULES = r"""
wordpress | WordPress | cms
drupal | Drupal | cms
joomla | Joomla | cms
ghost | Ghost | cms
shopify | Shopify | ecommerce
squarespace | Squarespace | cms
wix | Wix | cms
webflow | Webflow | cms
gatsby | Gatsby | frontend
hugo | Hugo | frontend
jekyll | Jekyll | frontend
next\.js | Next.js | frontend
"""


def _cells(text: str) -> list[list[str]]:
    return [line.split(" | ") for line in text.strip().splitlines()]


HEADER_RULES = [HeaderRule(*cells) for cells in _cells(_HEADER_RULES)]
GENERATOR_RULES = [GeneratorRule(*cells) for cells in _cells(_GENERATOR_RULES)]

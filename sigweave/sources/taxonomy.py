"""The alias taxonomy: a small dimension, always passed as a parameter."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

# Technology | category | aliases.  One technology a line, in natural order; the
# position of an alias in the whole list is its order number.
DEFAULT_TAXONOMY = """
React | frontend | react, reactjs, react.js, react js, react/redux, react hooks
Vue.js | frontend | vue, vuejs, vue.js, vue 3, vue 2, nuxt, nuxtjs
Angular | frontend | angular, angularjs, angular.js, angular 2+, angular2, ng
Next.js | frontend | next.js, nextjs, next js
Svelte | frontend | svelte, sveltekit, svelte kit
TypeScript | language | typescript, ts, tsx
JavaScript | language | javascript, js, es6, es2015, ecmascript, vanilla js, node.js, nodejs, node js
Django | backend | django, django rest framework, drf, django rest
FastAPI | backend | fastapi, fast api
Flask | backend | flask
Express.js | backend | express, expressjs, express.js, express js
NestJS | backend | nestjs, nest.js, nest js
Ruby on Rails | backend | rails, ruby on rails, ror, ruby/rails, rails api
Laravel | backend | laravel, php laravel
Spring Boot | backend | spring boot, spring, spring framework, spring mvc
Go | language | golang, go, go lang
Rust | language | rust, rust lang, rustlang
Python | language | python, python3, python 3, python2, py
Java | language | java, java 8, java 11, java 17, java 21
Kotlin | language | kotlin, kotlin jvm
Scala | language | scala, scala/akka
PHP | language | php, php 8, php7, php8
C# | language | c#, csharp, c sharp, .net, dotnet, asp.net, aspnet
Elixir | language | elixir, phoenix, elixir/phoenix
Clojure | language | clojure, clojurescript
PostgreSQL | database | postgres, postgresql, pg, psql
MySQL | database | mysql, mariadb, maria db
MongoDB | database | mongodb, mongo, mongo db
Redis | database | redis, redis cache, redis cluster
Elasticsearch | database | elasticsearch, elastic search, opensearch, open search
Cassandra | database | cassandra, apache cassandra
DynamoDB | database | dynamodb, dynamo, aws dynamodb
Snowflake | database | snowflake, snowflake db
BigQuery | database | bigquery, big query, google bigquery
ClickHouse | database | clickhouse, click house
AWS | cloud | aws, amazon web services, amazon aws, aws cloud
GCP | cloud | gcp, google cloud, google cloud platform
Azure | cloud | azure, microsoft azure, ms azure
Kubernetes | infrastructure | kubernetes, k8s, k 8s, kube
Docker | infrastructure | docker, docker containers, docker compose, containerization
Terraform | infrastructure | terraform, terraform cloud, tf
Helm | infrastructure | helm, helm charts
Apache Spark | data | spark, apache spark, pyspark, spark sql
Apache Kafka | data | kafka, apache kafka, kafka streams
Airflow | data | airflow, apache airflow
dbt | data | dbt, data build tool
PyTorch | ml | pytorch, torch
TensorFlow | ml | tensorflow, tf, keras
scikit-learn | ml | scikit-learn, sklearn, scikit learn
Datadog | observability | datadog, data dog
New Relic | observability | new relic, newrelic
Grafana | observability | grafana, grafana labs
Prometheus | observability | prometheus, prom
Sentry | observability | sentry, sentry.io
PagerDuty | observability | pagerduty, pager duty
RabbitMQ | messaging | rabbitmq, rabbit mq, rabbit
SQS | messaging | sqs, aws sqs, amazon sqs
Celery | messaging | celery, celery worker
GitHub Actions | cicd | github actions, gh actions, gha
Jenkins | cicd | jenkins, jenkins ci, jenkinsfile
CircleCI | cicd | circleci, circle ci
GitLab CI | cicd | gitlab ci, gitlab ci/cd, .gitlab-ci
Auth0 | auth | auth0, auth 0
Okta | auth | okta, okta sso
Keycloak | auth | keycloak, key cloak
Stripe | payments | stripe, stripe api, stripe payments
Braintree | payments | braintree, brain tree
Salesforce | crm | salesforce, sfdc, salesforce crm
HubSpot | crm | hubspot, hub spot
"""

# A taxonomy is a dimension: it is brought to the planner, which refuses one beyond this many aliases.
MAX_ALIASES = 1_000_000

TAXONOMY_SCHEMA = "canonical string, category string, alias string, alias_ord int"


class Alias(NamedTuple):
    canonical: str
    category: str
    alias: str
    alias_ord: int


def parse_taxonomy(text: str) -> list[Alias]:
    rows: list[Alias] = []
    for line in text.strip().splitlines():
        canonical, category, aliases = (part.strip() for part in line.split(" | "))
        for alias in aliases.split(", "):
            rows.append(Alias(canonical, category, alias, len(rows)))
    return rows


def default_aliases() -> list[Alias]:
    return parse_taxonomy(DEFAULT_TAXONOMY)


def taxonomy_frame(spark: SparkSession, rows: Iterable[Alias] | None = None) -> DataFrame:
    data = [tuple(r) for r in (default_aliases() if rows is None else rows)]
    return spark.createDataFrame(data, TAXONOMY_SCHEMA)


def load_aliases(taxonomy: DataFrame, limit: int = MAX_ALIASES) -> list[Alias]:
    """Bring a taxonomy to the planner, refusing one that is no dimension any more."""
    rows = taxonomy.select("canonical", "category", "alias", "alias_ord").orderBy("alias_ord")
    found = [Alias(*r) for r in rows.take(limit + 1)]
    if len(found) > limit:
        raise ValueError(
            f"taxonomy has more than {limit} aliases"
        )
    return found


def alias_map(taxonomy: DataFrame) -> DataFrame:
    """One row per lower-case alias: the last technology to claim it, the position of the first."""
    return (
        taxonomy.groupBy(F.lower("alias").alias("alias"))
        .agg(
            F.max_by(F.struct("canonical", "category"), "alias_ord").alias("owner"),
            F.min("alias_ord").alias("alias_ord"),
        )
        .select("alias", "owner.canonical", "owner.category", "alias_ord")
    )


def resolved(rows: Iterable[Alias]) -> list[Alias]:
    """The same rule for rows already at the planner."""
    owner: dict[str, Alias] = {}
    first: dict[str, int] = {}
    for row in sorted(rows, key=lambda r: r.alias_ord):
        key = row.alias.lower()
        first.setdefault(key, row.alias_ord)
        owner[key] = row
    return [Alias(owner[a].canonical, owner[a].category, a, first[a]) for a in first]

"""Posting-shaped views of the driver's tables. One SQL text serves Spark and DuckDB: ``{name}`` stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewell.tables import table

VIEWS = {
    "candidates_v": """
SELECT doc_id AS candidate_id, substr(split_part(text, chr(10), 1), 1, 60) AS title,
  source || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ', Inc.' ELSE ' LLC' END AS company_name,
  CASE doc_id % 12 WHEN 0 THEN 'Bengaluru, Karnataka, India' WHEN 1 THEN 'Remote' WHEN 2 THEN 'San Francisco, CA' WHEN 3 THEN 'Gurgaon, Haryana, India'
    WHEN 4 THEN 'London, United Kingdom' WHEN 5 THEN 'Remote - India' WHEN 6 THEN 'Mumbai' WHEN 7 THEN 'Punjab, India' WHEN 8 THEN 'Hybrid, Bangalore'
    WHEN 9 THEN 'HQ' WHEN 10 THEN 'Remote - US only' ELSE 'Kerala' END AS location,
  CASE doc_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' WHEN 4 THEN 'adzuna' ELSE 'generic' END AS source_type,
  doc_id % 20 AS source_id, CASE WHEN doc_id % 5 < 3 THEN 'J' || (doc_id % 400) END AS source_job_id,
  CASE WHEN doc_id % 10 = 0 THEN 'REQ-' || (doc_id % 97) END AS requisition_id,
  'https://Jobs.example.com/' || source || '/' || (doc_id % 700) || '/?utm_source=feed&b=' || (doc_id % 3) || '#apply' AS canonical_url,
  text AS description
FROM {documents}""",
    "postings_v": """
SELECT p_partkey AS candidate_id, p_name || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE '!' END AS title,
  p_brand || CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' Inc.' END AS company_name,
  CASE p_size % 5 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Pune, India' WHEN 2 THEN 'Mumbai, India' WHEN 3 THEN 'Remote - India' ELSE 'Hybrid, Pune' END AS location,
  CASE p_partkey % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' WHEN 4 THEN 'adzuna' ELSE 'generic' END AS source_type,
  p_partkey % 7 AS source_id, CASE WHEN p_partkey % 5 = 0 THEN 'J' || (p_partkey % 45) END AS source_job_id,
  CASE WHEN p_partkey % 11 = 0 THEN 'R' || (p_partkey % 97) END AS requisition_id,
  'https://Jobs.example.com/' || (p_partkey % 901) || '/?utm_source=feed' AS canonical_url,
  p_name || ' role with ' || CASE p_partkey % 4 WHEN 0 THEN 'travel and benefits' WHEN 1 THEN 'benefits' WHEN 2 THEN 'a large and friendly team' ELSE 'travel' END AS description
FROM {part}""",
    "facts_v": """
SELECT doc_id,
  CASE doc_id % 9 WHEN 0 THEN 'Pay is ' || (10 + doc_id % 31) || '-' || (45 + doc_id % 17) || ' LPA plus bonus' WHEN 1 THEN 'We offer ₹' || (10 + doc_id % 83) || ',000 per month' WHEN 2 THEN (3 + doc_id % 41) || '.5 lakhs per annum'
    WHEN 3 THEN 'Rs. ' || (20 + doc_id % 29) || ',000 to Rs. ' || (60 + doc_id % 37) || ',000 per month' WHEN 4 THEN 'Competitive pay' WHEN 5 THEN 'INR ' || (1000000 + doc_id % 997) || ' / year' WHEN 6 THEN (1 + doc_id % 8) || '+ years of work'
    WHEN 7 THEN '₹' || (1 + doc_id % 4) || ',00,000 - ₹' || (5 + doc_id % 5) || ',00,000' ELSE 'hybrid role, 3 years' END AS text,
  CASE doc_id % 7 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'full_time' WHEN 2 THEN 'Contractor' WHEN 3 THEN 'Intern' WHEN 4 THEN 'Part time' WHEN 5 THEN 'Volunteer' END AS employment,
  CASE doc_id % 5 WHEN 0 THEN 'Pune' WHEN 1 THEN 'bangalore' WHEN 2 THEN '' WHEN 3 THEN 'Atlantis' ELSE 'New Delhi' END AS city,
  CASE doc_id % 4 WHEN 0 THEN 'KA' WHEN 1 THEN '' WHEN 2 THEN 'Tamil Nadu' END AS state,
  CASE doc_id % 3 WHEN 0 THEN 'india' WHEN 1 THEN 'remote_india' ELSE 'unknown' END AS relevance
FROM {documents}""",
    "pages_v": """
SELECT page_id, url, html || CASE page_id % 7
    WHEN 0 THEN '<a href="https://boards.greenhouse.io/acme">x</a>' WHEN 1 THEN '<a href="https://jobs.lever.co/globex/1">x</a>'
    WHEN 2 THEN '<a href="https://jobs.ashbyhq.com/initech">x</a> <a href="https://jobs.lever.co/globex">y</a>' WHEN 3 THEN '<a href="https://umbrella.workable.com/j/1">x</a>'
    WHEN 4 THEN '<a href="https://boards.greenhouse.io/embed/job_board?for=hooli">x</a>'
    WHEN 5 THEN '<script type="application/ld+json">{{"@type": "JobPosting", "title": "T"}}</script>' ELSE '' END AS html
FROM {pages}""",
    "runs_v": """
SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, ts AS finished_at, event_type = 'error' AS failed,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) AS fetched_count,
  CAST(floor(value / 2) AS BIGINT) AS inserted_count, CAST(floor(value / 3) AS BIGINT) AS updated_count, CAST(floor(value / 5) AS BIGINT) AS rejected_count,
  CASE WHEN event_type = 'error' THEN 'HTTP 503' END AS error_text, props AS source_job_id
FROM {events}""",
    "sources_v": """
SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' WHEN 4 THEN 'adzuna' ELSE 'generic' END AS source_type,
  'k' || s_suppkey AS external_key, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN n_name END AS company_name, s_acctbal > 0 AS enabled,
  CAST(CASE s_suppkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 1440 END AS INT) AS crawl_interval_minutes,
  CASE WHEN s_suppkey % 5 > 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (s_suppkey % 48) * INTERVAL '1' HOUR END AS next_crawl_at
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "jobs_v": """
SELECT o_orderkey AS id, 'Order ' || o_orderpriority || ' ' || (o_orderkey % 1000) AS title, c_mktsegment AS company, lower(c_mktsegment) AS company_normalized, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END AS company_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Chennai' WHEN 2 THEN 'Delhi' END AS city, CASE c_custkey % 4 WHEN 0 THEN 'Maharashtra' END AS state, 'IN' AS country_code,
  CASE c_custkey % 5 WHEN 0 THEN 'india' WHEN 1 THEN 'remote_india' WHEN 2 THEN 'not_india' WHEN 3 THEN 'unknown_remote' ELSE 'unknown' END AS relevance,
  CASE o_orderstatus WHEN 'F' THEN 'expired' ELSE 'active' END AS status, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS posted_at,
  CASE o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' END AS work_mode, 'order of ' || o_orderpriority AS description, c_name AS customer,
  'fp' || (o_orderkey - o_orderkey % 2) AS exact_fingerprint, CASE WHEN o_orderkey % 7 > 0 THEN 'ready' ELSE 'pending' END AS structure_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "acks_v": """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS target, 'fp' || o_orderkey AS external_key FROM {orders} WHERE o_orderkey % 5 < 3""",
}

_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a frame over the Parquet tables; Spark prunes and pushes through it like through any other plan."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))})


def duck(name: str) -> str:
    """The same view as a DuckDB common table expression."""
    return f"{name} AS ({_TABLE.sub(lambda m: m[1], VIEWS[name]).replace('{{', '{').replace('}}', '}')})"

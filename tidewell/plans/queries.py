"""Registered queries: each applies operators to the driver's tables; most have the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import facts, fixed, geo, similarity, text
from tidewell.operators import freshness, resolve, serve, structure, sync
from tidewell.sources import detect, envelopes, normalize, raw
from tidewell.tables import table

from .views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-02 00:00:00"


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name; ``views`` go before the SQL as common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            QUERY_SQL = sql if not views else "WITH " + ",\n".join(map(duck, views)) + ("," if sql.lstrip().startswith("+") else "") + "\n" + sql.lstrip().lstrip("+")
            ORACLE_SQL[f.__name__] = QUERY_SQL
        return f

    return add


SUFFIX = "( (" + "|".join(fixed.COMPANY_SUFFIXES) + "))+$"
TOK = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
COMPANY = f"regexp_replace({TOK}, '{SUFFIX}', '')"
ALIAS = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '\bbangalore\b', 'bengaluru', 'g'), '\bbombay\b', 'mumbai', 'g'), '\bgurgaon\b', 'gurugram', 'g')"
LOCATION = TOK.format(ALIAS).replace("lower(regexp", "(regexp")
FP = "sha256(" + COMPANY.format("company_name") + " || '|' || " + TOK.format("title") + " || '|' || " + LOCATION.format("location") + " || '|' || coalesce(" + TOK.format("requisition_id") + ", ''))"
URL_KEY = (
    "rtrim(lower(regexp_extract(canonical_url, '^[^?#]*') || CASE WHEN q = '' THEN '' ELSE '?' || q END), '/')"
)
WITH_Q = (
    "array_to_string(list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(["
    + ", ".join(f"'{p}'" for p in fixed.TRACKING_PARAMS)
    + "], lower(split_part(p, '=', 1)))), '&')"
)
TEXT_KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2))), ' ')"


def _q(p: str) -> str:
    return p.replace("'", "''")


RELEVANT = f"""CASE WHEN regexp_matches(loc, '{_q(geo.CITY)}') OR (regexp_matches(loc, '\\bindia\\b') AND NOT excluded) THEN 'india'
  WHEN regexp_matches(loc, '{_q(geo.STATE)}') AND NOT far AND NOT excluded THEN 'india'
  WHEN NOT excluded AND regexp_matches(nar, '{_q(geo.REMOTE_INDIA)}') THEN 'remote_india'
  WHEN excluded OR far OR regexp_matches(nar, '{_q(geo.US_ONLY)}') THEN 'not_india'
  WHEN regexp_matches(loc, '{_q(geo.REMOTE)}') OR regexp_matches(nar, '{_q(geo.REMOTE)}') THEN 'unknown_remote' ELSE 'unknown' END"""
CLASSIFIED = f"""+ p AS (SELECT candidate_id, {ALIAS.format('location')} AS loc, {ALIAS.format("(location || ' ' || title || ' ' || description)")} AS nar FROM candidates_v),
x AS (SELECT *, regexp_matches(nar, '{_q(geo.EXCLUDED)}') AS excluded, regexp_matches(loc, '{_q(geo.FOREIGN)}') AS far FROM p),
r AS (SELECT candidate_id, {RELEVANT} AS relevance FROM x)
"""


# --- text, url, hash functions ---------------------------------------------------------------------------------


@query(f"SELECT candidate_id, {COMPANY.format('company_name')} AS company FROM candidates_v", "candidates_v")
def normalize_company(spark, sf_dir):
    return view(spark, sf_dir, "candidates_v").select("candidate_id", text.normalize_company("company_name").alias("company"))


@query(
    f"SELECT candidate_id, {TOK.format('title')} AS title_key, {LOCATION.format('location')} AS location_key, coalesce({TOK.format('requisition_id')}, '') AS requisition FROM candidates_v",
    "candidates_v",
)
def title_location_norm(spark, sf_dir):
    return view(spark, sf_dir, "candidates_v").select(
        "candidate_id", text.normalize_title("title").alias("title_key"), text.normalize_location("location").alias("location_key"), text.normalize_requisition("requisition_id").alias("requisition")
    )


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda x: CASE x WHEN 'sr' THEN 'senior' WHEN 'jr' THEN 'junior' ELSE x END), ' ') AS title FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'Jr ' ELSE '' END || source || ' (Engineer)' AS t FROM documents)")
def fuzzy_titles(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "Sr. ").when(F.col("doc_id") % 3 == 1, "Jr ").otherwise(""), "source", F.lit(" (Engineer)"))
    return table(spark, sf_dir, "documents").select("doc_id", text.fuzzy_title(t).alias("title"))


@query(f"SELECT page_id, rtrim(lower(regexp_extract(url, '^[^?#]*') || CASE WHEN q = '' THEN '?' ELSE '?' || q || '&' END || 'p' || page_id || '=~%2a+x%26'), '/') AS url FROM (SELECT *, {WITH_Q.format('url')} AS q FROM pages)")
def normalize_url(spark, sf_dir):
    """Page URLs, each with one more parameter whose value is written in other escapes than the form's own."""
    bare = F.regexp_replace("url", "#.*$", "")
    url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("p"), "page_id", F.lit("=%7e*%20x%26#top"))
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url(url).alias("url"))


@query(f"SELECT doc_id, sha256({TEXT_KEY.format('text')}) AS fingerprint FROM documents")
def token_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.token_fingerprint("text"), 256).alias("fingerprint"))


@query(f"SELECT candidate_id, {FP} AS fingerprint FROM candidates_v", "candidates_v")
def exact_fingerprint(spark, sf_dir):
    return view(spark, sf_dir, "candidates_v").select("candidate_id", text.exact_fingerprint("company_name", "title", "location", "requisition_id").alias("fingerprint"))


@query("""SELECT event_id, sha256('{"a":"' || event_type || '","k":' || regexp_extract(props, '[0-9]+') || '}') AS digest FROM events""")
def payload_hash(spark, sf_dir):
    body = F.concat(F.lit('{"k": '), F.regexp_extract("props", "[0-9]+", 0), F.lit(', "a":"'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", text.hash_payload(F.parse_json(body)).alias("digest"))


SPACED = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
BARE = SPACED.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, {BARE} AS bare FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("bare"))


@query(r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS back, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS basic,
 make_timestamp(CAST(1700000000 + event_id AS BIGINT) * 1000000) AS seconds, make_timestamp(CAST(1700000000 + event_id AS BIGINT) * 1000000) AS millis FROM events""")
def timestamps(spark, sf_dir):
    iso = text.iso_z(F.col("ts").cast("timestamp"))
    n = F.lit(1700000000).cast("long") + F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", iso.alias("iso"), text.iso_z(text.parse_iso_ts(iso)).alias("back"), text.iso_z(text.parse_iso_ts(F.date_format("ts", "yyyyMMdd"))).alias("basic"),
        text.parse_epoch(n).cast("timestamp_ntz").alias("seconds"), text.parse_epoch(n * 1000).cast("timestamp_ntz").alias("millis"),
    )


@query(r"""SELECT candidate_id, sha256('t|v1|' || trim(lower(regexp_replace(title || chr(10) || location || chr(10) || description, '\s+', ' ', 'g')))) AS key,
 sha256('v1' || chr(10) || title || chr(10) || description || chr(10) || location || chr(10) || canonical_url) AS digest FROM candidates_v""", "candidates_v")
def cache_keys(spark, sf_dir):
    v = view(spark, sf_dir, "candidates_v")
    return v.select("candidate_id", text.cache_key("t", "v1", text.normalized_input_text("title", "location", "description")).alias("key"), text.structure_hash("title", "description", "location", "canonical_url").alias("digest"))


@query("""SELECT id, nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(state), ''), nullif(trim(country_code), '')), '') AS place,
 CASE WHEN id % 4 = 0 THEN CASE WHEN id % 6 > 0 THEN (id % 6) || ' years' END WHEN id % 6 = 0 THEN '0–' || (id % 9) || ' years' ELSE (id % 6) || '–' || (id % 9) || ' years' END AS label FROM jobs_v""", "jobs_v")
def labels_of_jobs(spark, sf_dir):
    j = view(spark, sf_dir, "jobs_v")
    low, high = F.col("id") % 6, F.when(F.col("id") % 4 != 0, F.col("id") % 9)
    return j.select("id", text.job_location("city", "state", "country_code").alias("place"), text.experience_label(low, high).alias("label"))


@query(r"""SELECT id, 'TITLE: ' || title || chr(10) || 'COMPANY: ' || company || chr(10) || 'LOCATION: ' || concat_ws(', ', city, state, country_code) || chr(10) || 'EMPLOYMENT: ' || chr(10) || 'WORK MODE: ' || coalesce(work_mode, '') || chr(10) || 'POSTING:' || chr(10) || description || chr(10) AS prompt FROM jobs_v""", "jobs_v")
def prompts(spark, sf_dir):
    j = view(spark, sf_dir, "jobs_v")
    return j.select("id", text.prompt_text("title", "company", "city", "state", "country_code", F.lit(None).cast("string"), "work_mode", "description").alias("prompt"))


# --- places and relevance --------------------------------------------------------------------------------------


@query("""+ s AS (SELECT candidate_id, list_filter(list_transform(string_split(location, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM candidates_v),
h AS (SELECT *, lower(parts[len(parts)]) IN ('india', 'in', 'bharat') AS home FROM s), r AS (SELECT *, CASE WHEN home THEN parts[1:len(parts) - 1] ELSE parts END AS rest FROM h)
SELECT candidate_id, rest[1] AS city, rest[2] AS state, CASE WHEN home THEN 'IN' END AS country FROM r""", "candidates_v")
def place_split(spark, sf_dir):
    v = view(spark, sf_dir, "candidates_v").select("candidate_id", geo.split_place(F.array("location")).alias("p"))
    return v.select("candidate_id", "p.city", "p.state", "p.country")


@query(CLASSIFIED + "SELECT * FROM r", "candidates_v")
def relevance_rows(spark, sf_dir):
    v = view(spark, sf_dir, "candidates_v")
    return v.select("candidate_id", geo.classify_relevance(F.array("location"), "title", "description").alias("relevance"))


@query(CLASSIFIED + "SELECT relevance, count(*) AS n FROM r GROUP BY 1", "candidates_v")
def relevance_counts(spark, sf_dir):
    return serve.count_by(relevance_rows(spark, sf_dir), "relevance")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'hybrid') THEN 'hybrid' WHEN contains(lower(text), 'remote') OR contains(lower(text), 'work from home') OR relevance = 'remote_india' THEN 'remote'
 WHEN contains(lower(text), 'on-site') OR contains(lower(text), 'onsite') OR contains(lower(text), 'on site') OR contains(lower(text), 'in-office') OR contains(lower(text), 'in office') THEN 'onsite'
 WHEN city <> '' AND relevance = 'india' THEN 'onsite' END AS mode, CASE WHEN contains(lower(city), 'hybrid') THEN 'hybrid' WHEN contains(lower(city), 'remote') THEN 'remote' END AS by_place FROM facts_v""", "facts_v")
def work_mode(spark, sf_dir):
    v = view(spark, sf_dir, "facts_v")
    return v.select("doc_id", geo.infer_work_mode(F.lit(None).cast("string"), "text", "city", "relevance").alias("mode"), geo.work_mode_from_location(F.array("city")).alias("by_place"))


# a known city or a word of the text; a code of two letters, a name, a word of the text, blank or null
CITY_INPUT = "CASE doc_id % 3 WHEN 0 THEN split_part(text, ' ', 1) ELSE CASE length(text) % {} {} END || ' ' END".format(len(fixed.CITY_STATES), " ".join(f"WHEN {i} THEN '{c.title()}'" for i, c in enumerate(fixed.CITY_STATES)))
STATE_INPUT = """CASE doc_id % 6 WHEN 0 THEN ' ' || upper(chr(CAST(97 + doc_id % 26 AS INT))) || chr(CAST(97 + length(text) % 26 AS INT)) WHEN 1 THEN substr(text, 1, CAST(1 + doc_id % 4 AS INT))
 WHEN 2 THEN CASE length(text) % 4 WHEN 0 THEN 'Tamil Nadu' WHEN 1 THEN 'ka' WHEN 2 THEN 'MH' ELSE 'dl ' END WHEN 3 THEN '  ' END"""


def _pairs(known: dict) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in known.items()) + ")"


@query(f"""WITH x AS (SELECT doc_id, lower(trim({CITY_INPUT})) AS city, trim({STATE_INPUT}) AS state FROM documents)
SELECT doc_id, CASE WHEN coalesce(state, '') = '' THEN c.v WHEN length(state) <= 3 THEN coalesce(s.v, state) ELSE state END AS state
FROM x LEFT JOIN {_pairs(fixed.CITY_STATES)} AS c(k, v) ON x.city = c.k LEFT JOIN {_pairs(fixed.STATE_CODES)} AS s(k, v) ON lower(x.state) = s.k""")
def state_fill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", geo.fill_state(F.expr(CITY_INPUT), F.expr(STATE_INPUT)).alias("state"))


# two letters of numbers, the head of a segment, written codes, a letter and a digit, null
COUNTRY_INPUT = """CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN chr(CAST(97 + c_nationkey AS INT)) || ' ' WHEN c_custkey % 4 = 1 THEN lower(substr(c_mktsegment, 1, CAST(1 + c_custkey % 3 AS INT)))
 WHEN c_custkey % 4 = 2 THEN ' ' || CASE c_nationkey % 5 WHEN 0 THEN 'ind' WHEN 1 THEN 'Usa' WHEN 2 THEN 'UK' WHEN 3 THEN 'gbr' ELSE 'Germany' END ELSE chr(CAST(97 + c_nationkey AS INT)) || chr(CAST(44 + c_custkey % 78 AS INT)) END"""


@query(f"""WITH k AS (SELECT c_custkey, upper(trim({COUNTRY_INPUT})) AS u FROM customer)
SELECT c_custkey, CASE WHEN u = 'IND' THEN 'IN' WHEN u = 'USA' THEN 'US' WHEN u IN ('GBR', 'UK') THEN 'GB' WHEN regexp_full_match(u, '[A-Z][A-Z]') THEN u END AS code FROM k""")
def country_codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", geo.normalize_country_code(F.expr(COUNTRY_INPUT)).alias("code"))


# --- typed facts ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 100000 * (10 + doc_id % 31) WHEN 1 THEN 1000 * (10 + doc_id % 83) WHEN 2 THEN 100000 * (3 + doc_id % 41) + 50000 WHEN 3 THEN 1000 * (20 + doc_id % 29) WHEN 5 THEN 1000000 + doc_id % 997 WHEN 7 THEN 100000 * (1 + doc_id % 4) END AS salary_min,
 CASE doc_id % 9 WHEN 0 THEN 100000 * (45 + doc_id % 17) WHEN 3 THEN 1000 * (60 + doc_id % 37) WHEN 7 THEN 100000 * (5 + doc_id % 5) END AS salary_max, CASE WHEN doc_id % 9 IN (0, 1, 2, 3, 5, 7) THEN 'INR' END AS salary_currency,
 CASE WHEN doc_id % 9 IN (1, 3) THEN 'month' WHEN doc_id % 9 IN (0, 2, 5, 7) THEN 'year' END AS salary_period FROM documents""")
def salary_parse(spark, sf_dir):
    v = view(spark, sf_dir, "facts_v").select("doc_id", facts.parse_salary("text").alias("s"))
    return v.select("doc_id", "s.*")


# a type as it is named, words of the text, types with a character of the text between their parts
EMPLOYMENT_INPUT = """CASE doc_id % 4 WHEN 0 THEN 'Full' || substr(text, CAST(1 + doc_id % 50 AS INT), 1) || 'TIME' WHEN 1 THEN split_part(text, ' ', CAST(1 + doc_id % 5 AS INT))
 WHEN 2 THEN CASE length(text) % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'Free-Lance' WHEN 2 THEN 'permanent.' WHEN 3 THEN 'TEMP' WHEN 4 THEN 'temporary' ELSE 'Contractor (B2B)' END
 ELSE substr(text, CAST(1 + doc_id % 30 AS INT), 1) || CASE length(text) % 4 WHEN 0 THEN 'part time' WHEN 1 THEN 'Intern' WHEN 2 THEN 'internship' ELSE 'con tract' END END"""


@query(f"""WITH e AS (SELECT doc_id, {EMPLOYMENT_INPUT} AS e FROM documents), k AS (SELECT doc_id, e, regexp_replace(lower(e), '[^a-z]', '', 'g') AS t FROM e)
SELECT doc_id, CASE WHEN e IN ('full_time', 'part_time', 'contract', 'internship', 'temporary') THEN e WHEN t IN ('fulltime', 'permanent') THEN 'full_time' WHEN t = 'parttime' THEN 'part_time'
 WHEN t IN ('contract', 'contractor', 'freelance') THEN 'contract' WHEN t IN ('intern', 'internship') THEN 'internship' WHEN t IN ('temporary', 'temp') THEN 'temporary' END AS kind FROM k""")
def employment_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", facts.normalize_employment(F.expr(EMPLOYMENT_INPUT)).alias("kind"))


RESPONSES = """
SELECT doc_id, text AS posting, CASE doc_id % 5 WHEN 4 THEN 'no json' ELSE
 '{"summary": "S", "skills": ["' || split_part(text, ' ', 1) || '", "Quantum Basketry", 7, " <b>' || split_part(text, ' ', 2) || '</b>", "' || split_part(text, ' ', 1) || '&amp;' || split_part(text, ' ', 2) || '"], "experience_min_years": ' || CASE doc_id % 3 WHEN 0 THEN '"3"' WHEN 1 THEN '77777' ELSE '4.5' END || ', "experience_label": "77777+ years", "work_mode": "remote",
 "employment_type": "contract", "requirements": ["<p>' || split_part(text, ' ', 2) || ' &amp; co</p>", " ", "<br>"], "description_text": "' || split_part(text, ' ', 2) || ' zzzz"}' END AS response
FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '') AS text FROM {documents})"""


def _responses(spark, sf_dir):
    return spark.sql(RESPONSES.replace('{"summary"', '{{"summary"').replace('zzzz"}\'', 'zzzz"}}\''), documents=table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN list_filter([w1, w2, w1 || '&' || w2], lambda s: regexp_matches(lower(s), '[a-z0-9]') AND contains(' ' || p || ' ', ' ' || trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) || ' ')) END AS skills,
 CASE WHEN doc_id % 5 < 4 AND doc_id % 3 = 2 AND regexp_matches(posting, '(^|[^0-9])4\\.5($|[^0-9])') THEN 4.5 END AS years
 FROM (SELECT doc_id, posting, split_part(posting, ' ', 1) AS w1, split_part(posting, ' ', 2) AS w2, trim(regexp_replace(lower(posting), '[^a-z0-9]+', ' ', 'g')) AS p FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS posting FROM documents))""")
def ground_facts(spark, sf_dir):
    v = _responses(spark, sf_dir).withColumn("f", facts.coerce_facts("response"))
    return v.select("doc_id", facts.ground_skills("f.skills", "posting").alias("skills"), facts.ground_experience("f.experience_min_years", "f.experience_label", "posting")["experience_min_years"].alias("years"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1) AS valid, CASE WHEN doc_id % 4 IN (0, 1) THEN 'T' || doc_id END AS title FROM documents")
def enrich_valid(spark, sf_dir):
    """Well-formed answers, one with an extra key, one with a range the wrong way round."""
    body = lambda extra, low: F.concat(F.lit('{"normalized_title": "T'), F.col("doc_id"), F.lit(f'", "role_category": null, "seniority": null, "skills": ["x"], "experience_min": {low}, "experience_max": 5, "work_mode": null, "india_eligibility": "india"{extra}}}'))
    response = F.when(F.col("doc_id") % 4 < 2, body("", 1)).when(F.col("doc_id") % 4 == 2, body(', "more": 1', 1)).otherwise(body("", 9))
    e = table(spark, sf_dir, "documents").select("doc_id", structure.validate_enrichment(response).alias("e"))
    return e.select("doc_id", F.col("e").isNotNull().alias("valid"), F.col("e.normalized_title").alias("title"))


@query("""SELECT event_id, hit OR n <= 25 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY day, hit ORDER BY ts, key) AS n FROM (SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type = 'view' AS hit, CAST(event_id AS VARCHAR) AS key FROM events))""")
def budget_admit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.col("ts").alias("arrival"), (F.col("event_type") == "view").alias("hit"), F.col("event_id").cast("string").alias("cache_key"))
    return structure.admit_under_budget(e, 25).select("event_id", "admitted")


# --- raw history and sources -------------------------------------------------------------------------------------


def _envelopes(spark, sf_dir):
    """Board responses made of documents, one response a document with one posting; the whole text is its description."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<p>"), escaped, F.lit("</p>"))
    encoded = F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    d = table(spark, sf_dir, "documents").withColumns({"title": F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", ""), "seq": F.col("doc_id")})
    job = {
        "greenhouse": F.struct(F.col("doc_id").alias("id"), "title", F.col("source").alias("company_name"), F.concat(F.lit("https://b/"), "doc_id").alias("absolute_url"), encoded.alias("content"), F.struct(F.lit("Pune; Delhi").alias("name")).alias("location"), F.lit("2024-03-01T10:00:00Z").alias("updated_at")),
        "lever": F.struct(F.col("doc_id").alias("id"), F.col("title").alias("text"), F.concat(F.lit("https://l/"), "doc_id").alias("hostedUrl"), F.struct(F.lit("Pune").alias("location"), F.array(F.lit("Delhi")).alias("allLocations"), F.lit("Full-time").alias("commitment")).alias("categories"), F.lit(1709287200000).alias("createdAt"), F.concat(F.lit("  "), "text").alias("descriptionPlain")),
        "ashby": F.struct(F.col("doc_id").alias("id"), "title", F.concat(F.lit("https://a/"), "doc_id").alias("jobUrl"), F.lit("Pune").alias("location"), F.array(F.lit("Delhi"), F.lit("Pune")).alias("secondaryLocations"), F.lit("FullTime").alias("employmentType"), encoded.alias("descriptionHtml"), F.lit("2024-03-01").alias("publishedAt")),
        "workable": F.struct(F.concat(F.lit("S"), "doc_id").alias("shortcode"), "title", F.concat(F.lit("https://w/"), "doc_id").alias("url"), F.lit("Pune").alias("city"), F.lit("India").alias("country"), encoded.alias("description"), F.lit("2024-03-01").alias("published_on")),
    }
    body = lambda k: F.to_json(F.array(job[k])) if k == "lever" else F.to_json(F.struct(F.array(job[k]).alias("jobs"), F.lit("Acme").alias("name")))
    kind = F.element_at(F.array(*[F.lit(k) for k in job]), (F.col("doc_id") % 4 + 1).cast("int"))
    chosen = F.coalesce(*[F.when(kind == k, body(k)) for k in job])
    return d.select(kind.alias("source_type"), F.col("source").alias("source_external_key"), F.lit("2024-03-02").cast("timestamp").alias("fetched_at"), chosen.alias("body"))


def _all_envelopes(spark, sf_dir):
    return envelopes.envelopes_boards(_envelopes(spark, sf_dir))


@query("SELECT k AS source_type, source AS source_external_key, CASE WHEN k = 'workable' THEN 'S' ELSE '' END || doc_id AS source_job_id, 'https://' || CASE k WHEN 'greenhouse' THEN 'b' ELSE k[1] END || '/' || doc_id AS source_url FROM (SELECT *, ['greenhouse', 'lever', 'ashby', 'workable'][doc_id % 4 + 1] AS k FROM documents)")
def board_envelopes(spark, sf_dir):
    return _all_envelopes(spark, sf_dir).select("source_type", "source_external_key", "source_job_id", "source_url")


@query("""SELECT k AS source_type, CASE WHEN k = 'workable' THEN 'S' ELSE '' END || doc_id AS source_job_id, nullif(trim(regexp_replace(left(text, 40), '[^A-Za-z ]', '', 'g')), '') AS title_original, source AS company_name,
 CASE k WHEN 'greenhouse' THEN ['Pune', 'Delhi'] WHEN 'lever' THEN ['Pune', 'Delhi'] WHEN 'ashby' THEN ['Pune', 'Delhi'] ELSE ['Pune, India'] END AS locations_raw, CASE k WHEN 'lever' THEN 'Full-time' WHEN 'ashby' THEN 'FullTime' END AS employment_type,
 CASE k WHEN 'greenhouse' THEN '2024-03-01T10:00:00Z' WHEN 'lever' THEN '2024-03-01T10:00:00Z' ELSE '2024-03-01T00:00:00Z' END AS posted, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS description_text
 FROM (SELECT *, ['greenhouse', 'lever', 'ashby', 'workable'][doc_id % 4 + 1] AS k FROM documents) WHERE trim(regexp_replace(left(text, 40), '[^A-Za-z ]', '', 'g')) <> ''""")
def normalize_boards(spark, sf_dir):
    e = _all_envelopes(spark, sf_dir)
    sources = e.select("source_type", "source_external_key", F.col("source_external_key").alias("company_name")).distinct()
    good, _ = normalize.normalize_with_quarantine(e, sources)
    return good.select("source_type", "source_job_id", "title_original", "company_name", "locations_raw", "employment_type", text.iso_z("posted_at").alias("posted"), "description_text")


def _ld_pages(spark, sf_dir):
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@graph": [{"@type": [["Thing"], ["https://schema.org/JobPosting/"]], "title": "Job '), F.col("page_id"),
        F.lit('", "hiringOrganization": {"name": "Org"}, "identifier": {"value": '), F.col("page_id"),
        F.lit('}, "jobLocation": [[{"address": {"addressLocality": "Pune", "addressCountry": {"name": "India"}}}, ["Site '), F.regexp_extract("url", "([a-z.]+)/", 1), F.lit('"]], "Remote"], "employmentType": ["A", "B"], "description": "<b>x</b> y", "datePosted": "2024-02-03"}, {"@type": "a#JobPosting"}, {"@type": {"JobPosting": 1}}]}</script><script type="application/ld+json">{bad</script>'),
    )
    p = table(spark, sf_dir, "pages")
    return p.select("url", F.concat("html", ld).alias("html"), F.lit("site").alias("source_external_key"), F.lit("2024-03-02").cast("timestamp").alias("fetched_at"))


@query("SELECT CAST(page_id AS VARCHAR) AS source_job_id, 'Job ' || page_id AS title_original, 'Org' AS company_name, ['Pune, India', trim('Site ' || regexp_extract(url, '([a-z.]+)/', 1)), 'Remote'] AS locations_raw, 'A, B' AS employment_type, 'x y' AS description_text, '2024-02-03T00:00:00Z' AS posted FROM pages")
def normalize_ld_pages(spark, sf_dir):
    n = normalize.normalize_jsonld(envelopes.envelopes_jsonld(_ld_pages(spark, sf_dir)))
    return n.select("source_job_id", "title_original", "company_name", "locations_raw", "employment_type", "description_text", text.iso_z("posted_at").alias("posted"))


def _raw(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("source_id"), (F.col("event_id") % 40).cast("string").alias("source_job_id"), F.sha2(F.col("event_type"), 256).alias("payload_hash"), F.col("ts").alias("fetched_at"))


RAW = "raw_v AS (SELECT event_id AS id, user_id % 50 AS source_id, CAST(event_id % 40 AS VARCHAR) AS source_job_id, sha256(event_type) AS payload_hash, ts AS fetched_at FROM events)"


@query(f"""WITH {RAW}, f AS (SELECT *, row_number() OVER (PARTITION BY source_id, source_job_id, payload_hash ORDER BY fetched_at NULLS LAST, id) AS n FROM raw_v WHERE id % 2 = 0)
SELECT id FROM f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM raw_v h WHERE h.id % 2 = 1 AND h.source_id = f.source_id AND h.source_job_id = f.source_job_id AND h.payload_hash = f.payload_hash)""")
def raw_append(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return raw.append_raw_if_new(r.where("id % 2 = 0"), r.where("id % 2 = 1")).select("id")


@query(f"WITH {RAW} SELECT source_id, source_job_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_job_id ORDER BY fetched_at DESC, id DESC) AS n FROM raw_v) WHERE n = 1")
def latest_raw(spark, sf_dir):
    return raw.latest_raw(_raw(spark, sf_dir)).select("source_id", "source_job_id", "id")


@query(f"WITH {RAW} SELECT id FROM raw_v WHERE source_id = 7")
def raw_ids(spark, sf_dir):
    return raw.raw_ids_for_source(_raw(spark, sf_dir), 7)


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 = 0 END, s_acctbal > 0) AS enabled, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 3 END ELSE 2 END AS consecutive_failures,
 CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'no jobs returned' END AS disabled_reason, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-02 06:00:00' END AS next_crawl_at FROM supplier""")
def seed_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.lit("lever").alias("source_type"), F.col("s_suppkey").cast("string").alias("external_key"), F.col("s_name").alias("name"), F.col("s_name").alias("company_name"), F.lit("u").alias("base_url"), (F.col("s_acctbal") > 0).alias("enabled"), F.lit(None).cast("int").alias("crawl_interval_minutes"), F.lit(None).cast("timestamp").alias("next_crawl_at"), F.lit(2).alias("consecutive_failures"), F.lit(None).cast("string").alias("disabled_reason"))
    seeds = s.where("s_suppkey % 2 = 0").select(F.lit("lever").alias("source_type"), F.col("s_suppkey").cast("string").alias("external_key"), F.lit("n").alias("name"), F.lit("c").alias("company_name"), F.lit("v").alias("base_url"), F.lit(None).cast("int").alias("crawl_interval_minutes"), F.lit(NOW).cast("timestamp").alias("checked_at"), F.when(F.col("s_suppkey") % 4 != 0, "no jobs returned").alias("reason"))
    new = raw.seed_sources(old, seeds)
    return new.select(F.col("external_key").cast("long").alias("s_suppkey"), "enabled", "consecutive_failures", "disabled_reason", F.col("next_crawl_at").cast("timestamp_ntz").alias("next_crawl_at"))


# --- detection ----------------------------------------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN page_id % 7 IN (0, 1, 3, 4, 5) THEN 'detected' ELSE 'needs-review' END AS status, CASE page_id % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 3 THEN 'workable' WHEN 4 THEN 'greenhouse' WHEN 5 THEN 'generic-jsonld' END AS source_type,
 CASE page_id % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'globex' WHEN 3 THEN 'umbrella' WHEN 4 THEN 'hooli' END AS external_key,
 CASE page_id % 7 WHEN 0 THEN 'https://boards.greenhouse.io/acme' WHEN 1 THEN 'https://jobs.lever.co/globex/1' WHEN 2 THEN 'multiple ATS matches: ashby, lever' WHEN 3 THEN 'https://umbrella.workable.com/j/1'
  WHEN 4 THEN 'https://boards.greenhouse.io/embed/job_board?for=hooli' WHEN 5 THEN 'schema.org JobPosting JSON-LD' ELSE 'no supported ATS or JobPosting JSON-LD' END AS evidence FROM pages""")
def detect_sources(spark, sf_dir):
    return detect.detect(view(spark, sf_dir, "pages_v"))


@query("""SELECT s_suppkey, ['greenhouse', 'lever', 'ashby', 'workable'][s_suppkey % 4 + 1] AS kind, 'k' || s_suppkey AS board FROM supplier""")
def board_urls(spark, sf_dir):
    """A board's URL and back."""
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.EMPLOYER_SOURCES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", detect.board_url(kind, F.concat(F.lit("k"), "s_suppkey")).alias("url"))
    p = s.select("s_suppkey", detect.parse_board("url", F.lit("")).alias("p"))
    return p.select("s_suppkey", F.col("p.source_type").alias("kind"), F.col("p.external_key").alias("board"))


# --- entity resolution ----------------------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    c = resolve.with_identity(view(spark, sf_dir, "candidates_v"))
    return c.where("candidate_id % 3 = 0"), c.where("candidate_id % 3 <> 0").withColumnRenamed("candidate_id", "job_id")


IDENTITY = f"""+ i AS (SELECT candidate_id, source_id, source_job_id, {FP} AS fp, CASE WHEN source_job_id IS NOT NULL THEN source_id || '|' || source_job_id END AS pk,
 {URL_KEY} AS uk, CASE WHEN requisition_id IS NOT NULL THEN {COMPANY.format('company_name')} || '|' || {TOK.format('requisition_id')} END AS rk FROM (SELECT *, {WITH_Q.format('canonical_url')} AS q FROM candidates_v)),
c AS (SELECT * FROM i WHERE candidate_id % 3 = 0), j AS (SELECT candidate_id AS job_id, * FROM i WHERE candidate_id % 3 <> 0)
"""


@query(IDENTITY + """SELECT candidate_id, min(job_id) AS job_id FROM (SELECT c.candidate_id, j.job_id FROM c JOIN j ON c.fp = j.fp UNION ALL SELECT c.candidate_id, j.job_id FROM c JOIN j ON c.pk = j.pk
 UNION ALL SELECT c.candidate_id, j.job_id FROM c JOIN j ON c.uk = j.uk UNION ALL SELECT c.candidate_id, j.job_id FROM c JOIN j ON c.rk = j.rk) GROUP BY 1""", "candidates_v")
def match_exact(spark, sf_dir):
    c, j = _sides(spark, sf_dir)
    return resolve.find_exact(c, j)


@query(IDENTITY.replace("c AS (", "cc AS (") + f""", e AS (SELECT i.candidate_id, {FP} AS g, row_number() OVER (PARTITION BY {FP} ORDER BY CASE WHEN source_type IN ('greenhouse', 'lever', 'ashby', 'workable') THEN 0 WHEN source_type = 'adzuna' THEN 2 ELSE 3 END, i.candidate_id) AS n FROM candidates_v JOIN i USING (candidate_id))
SELECT candidate_id FROM e WHERE n = 1""", "candidates_v")
def canonical_jobs(spark, sf_dir):
    c = resolve.with_identity(view(spark, sf_dir, "candidates_v"))
    return resolve.collapse(c, "fingerprint", "candidate_id").select("candidate_id")


@query(IDENTITY.replace("c AS (", "cc AS (") + """, e AS (SELECT a.candidate_id AS u, b.v FROM i a JOIN (SELECT fp, min(candidate_id) AS v FROM i GROUP BY 1) b USING (fp) UNION SELECT a.candidate_id, b.v FROM i a JOIN (SELECT rk, min(candidate_id) AS v FROM i WHERE rk IS NOT NULL GROUP BY 1) b USING (rk)),
w AS (WITH RECURSIVE r AS (SELECT u AS n, u AS l FROM (SELECT u FROM e UNION SELECT v FROM e) UNION SELECT s.b, r.l FROM r JOIN (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e) s ON s.a = r.n AND r.l < s.b) SELECT n, min(l) AS l FROM r GROUP BY 1)
SELECT n AS candidate_id, l AS cluster FROM w""", "candidates_v")
def cluster_rows(spark, sf_dir):
    c = resolve.with_identity(view(spark, sf_dir, "candidates_v"))
    return resolve.clusters(c, keys=("fingerprint", "requisition_key"), fuzzy=False)


def _jobs_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    return o.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 4).alias("canonical_source_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "greenhouse").otherwise("adzuna").alias("canonical_source_type"), at.alias("first_seen_at"), at.alias("last_seen_at"), F.lit("expired").alias("status"),
    )


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS title, o_orderkey % 4 AS sid, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS rank, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 0),
c AS (SELECT o_orderkey AS job_id, 'new' AS title, o_orderkey % 3 AS sid, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 3 END AS rank FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(j.job_id, c.job_id) AS job_id, CASE WHEN c.job_id IS NOT NULL AND (j.job_id IS NULL OR j.sid = c.sid OR c.rank < j.rank) THEN c.title ELSE j.title END AS title, CASE WHEN c.job_id IS NULL THEN 'expired' ELSE 'active' END AS status,
 coalesce(j.at, TIMESTAMP '2024-01-02') AS first_seen_at, CASE WHEN c.job_id IS NULL THEN j.at ELSE TIMESTAMP '2024-01-02' END AS last_seen_at FROM j FULL JOIN c ON j.job_id = c.job_id""")
def job_upsert(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(
        F.col("o_orderkey").alias("job_id"), F.lit("new").alias("title"), (F.col("o_orderkey") % 3).alias("source_id"), F.when(F.col("o_orderkey") % 3 == 1, "lever").otherwise("generic").alias("source_type"), F.lit(NOW).cast("timestamp_ntz").alias("seen_at")
    )
    return resolve.upsert_job(_jobs_snapshot(spark, sf_dir), changes, ("title",)).select("job_id", "title", "status", "first_seen_at", "last_seen_at")


# --- freshness and crawls ---------------------------------------------------------------------------------------------


def _links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 20).alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_job_id"), (F.col("l_linenumber") % 2).alias("missing_count"), (F.col("l_quantity") > 10).alias("active"))


LINKS = """lk AS (SELECT l_orderkey AS job_id, l_suppkey % 20 AS source_id, l_orderkey || '-' || l_linenumber AS source_job_id, l_linenumber % 2 AS missing_count, l_quantity > 10 AS active, bool_or(l_discount > 0.05) OVER (PARTITION BY l_suppkey % 20, l_orderkey, l_linenumber) AS seen, l_suppkey % 20 < 10 AS crawled FROM lineitem),
nl AS (SELECT job_id, source_id, source_job_id, CASE WHEN crawled AND seen THEN 0 WHEN crawled AND active THEN missing_count + 1 ELSE missing_count END AS missing_count, CASE WHEN crawled AND seen THEN TRUE WHEN crawled AND active THEN missing_count + 1 < 2 ELSE active END AS active FROM lk)"""


def _crawl(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seen = li.where("l_discount > 0.05").select((F.col("l_suppkey") % 20).alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_job_id"))
    return seen, li.select((F.col("l_suppkey") % 20).alias("source_id")).where("source_id < 10").distinct()


@query(f"WITH {LINKS} SELECT * FROM nl")
def freshness_links(spark, sf_dir):
    seen, crawled = _crawl(spark, sf_dir)
    return freshness.apply_source_crawl(_links(spark, sf_dir), seen, crawled)


@query(f"WITH {LINKS} SELECT job_id, CASE WHEN bool_or(active) THEN 'active' ELSE 'expired' END AS status FROM nl GROUP BY 1")
def job_status(spark, sf_dir):
    return freshness.status_for_associations(freshness_links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT DISTINCT job_id FROM lk WHERE crawled")
def affected_jobs(spark, sf_dir):
    return freshness.affected_jobs(_links(spark, sf_dir), _crawl(spark, sf_dir)[1])


@query(f"""WITH {LINKS}, t AS (SELECT nl.job_id, bool_or(nl.active) AS a, bool_or(lk.seen) AS s, bool_or(lk.crawled) AS c FROM nl JOIN lk USING (source_id, source_job_id) GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN c THEN CASE WHEN a THEN 'active' ELSE 'expired' END ELSE o_orderstatus END AS status, c IS TRUE AS checked, c IS TRUE AND s AS seen FROM orders LEFT JOIN t ON o_orderkey = job_id""")
def finalize_freshness(spark, sf_dir):
    seen, crawled = _crawl(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), none.alias("last_checked_at"), none.alias("last_seen_at"))
    new, _ = freshness.finalize_source_freshness(jobs, _links(spark, sf_dir), seen, crawled, NOW)
    return new.select("job_id", "status", F.col("last_checked_at").isNotNull().alias("checked"), F.col("last_seen_at").isNotNull().alias("seen"))


@query("""WITH r AS (SELECT user_id % 100 AS s, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS seq, event_type, event_id % 30 AS job FROM events), c AS (SELECT s, seq, row_number() OVER (PARTITION BY s ORDER BY seq) AS n FROM (SELECT DISTINCT s, seq FROM r WHERE event_type <> 'error')),
l AS (SELECT r.s, job, max(n) AS last FROM r JOIN c USING (s, seq) GROUP BY 1, 2), m AS (SELECT s, max(n) AS crawls FROM c GROUP BY 1)
SELECT s AS source_id, CAST(job AS VARCHAR) AS source_job_id, least(2, crawls - last) AS missing_count, crawls - last < 2 AS active FROM l JOIN m USING (s)""")
def crawl_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("source_id"), F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).alias("seq"), "event_type", (F.col("event_id") % 30).cast("string").alias("source_job_id"))
    return freshness.crawl_history_state(e.where("event_type <> 'error'"), e)


@query("SELECT user_id AS source_id, count(*) AS fetched_count, count(*) FILTER (event_id % 2 = 0) AS inserted_count, count(*) FILTER (event_id % 2 = 1) AS updated_count, count(*) FILTER (event_type = 'error') AS rejected_count FROM events GROUP BY 1")
def crawl_outcome(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return freshness.crawl_outcome(e.select(F.col("user_id").alias("source_id"), (F.col("event_id") % 2 == 0).alias("is_new"), F.when(F.col("event_type") == "error", "x").alias("error")))


MINUTES = "CASE WHEN source_type IN ('adzuna', 'generic') THEN greatest(coalesce(crawl_interval_minutes, 0), 720) WHEN crawl_interval_minutes IS NOT NULL THEN crawl_interval_minutes WHEN source_type IN ('greenhouse', 'lever', 'ashby', 'workable') THEN 360 ELSE 720 END"


@query(f"SELECT id, {MINUTES} AS minutes, TIMESTAMP '{NOW}' + {MINUTES} * INTERVAL '1' MINUTE AS next_at FROM sources_v", "sources_v")
def next_crawl(spark, sf_dir):
    s = view(spark, sf_dir, "sources_v")
    at = F.lit(NOW).cast("timestamp_ntz")
    return s.select("id", freshness.interval_minutes("source_type", "crawl_interval_minutes").alias("minutes"), freshness.next_crawl("source_type", "crawl_interval_minutes", at).alias("next_at"))


@query(f"SELECT id, source_type, next_crawl_at FROM sources_v WHERE enabled AND (next_crawl_at IS NULL OR next_crawl_at <= TIMESTAMP '{NOW}') ORDER BY next_crawl_at NULLS FIRST", "sources_v")
def due_sources(spark, sf_dir):
    s = freshness.due_sources(view(spark, sf_dir, "sources_v"), F.lit(NOW).cast("timestamp"))
    return s.select("id", "source_type", F.col("next_crawl_at").cast("timestamp_ntz").alias("next_crawl_at"))


@query("""+ i AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS g FROM runs_v)
SELECT run_id, count(*) FILTER (failed) OVER (PARTITION BY source_id, g ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS streak FROM i""", "runs_v")
def failure_streak(spark, sf_dir):
    return freshness.failure_streaks(view(spark, sf_dir, "runs_v")).select("run_id", "streak")


@query(f"""+ l AS (SELECT source_id, arg_max(failed, (started_at, run_id)) AS failed FROM runs_v GROUP BY 1)
SELECT id, CASE WHEN l.source_id IS NULL THEN 1 WHEN failed THEN 2 ELSE 0 END AS consecutive_failures, enabled AND NOT coalesce(failed AND id % 2 = 0, FALSE) AS enabled FROM sources_v LEFT JOIN l ON id = l.source_id""", "sources_v", "runs_v")
def finished_crawls(spark, sf_dir):
    r = view(spark, sf_dir, "runs_v").groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("status"))
    r = r.select("source_id", "status", F.when(F.col("source_id") % 2 == 0, 404).otherwise(503).alias("http_status"), F.lit("HTTP").alias("error_text"), F.lit(NOW).cast("timestamp").alias("checked_at"))
    none = F.lit(None)
    s = view(spark, sf_dir, "sources_v").withColumns({"consecutive_failures": F.lit(1), "disabled_reason": none.cast("string"), "last_success_at": none.cast("timestamp"), "last_crawl_at": none.cast("timestamp")})
    return freshness.finish_crawls(s, r).select("id", "consecutive_failures", "enabled")


# --- serving -----------------------------------------------------------------------------------------------------------

PUB = "status = 'active' AND relevance IN ('india', 'remote_india')"


@query(f"SELECT id, title, company, posted_at FROM jobs_v WHERE {PUB} AND lower(city) = 'pune' AND (contains(lower(title), '1') OR contains(lower(company), '1') OR contains(lower(description), '1')) ORDER BY posted_at DESC NULLS LAST, id LIMIT 20 OFFSET 20", "jobs_v")
def search_page(spark, sf_dir):
    return serve.search_jobs(view(spark, sf_dir, "jobs_v"), page=2, q="1", city="Pune").select("id", "title", "company", "posted_at")


@query(f"SELECT total, CAST(least(900000, pages) AS INT) AS page, CAST(pages AS INT) AS page_count FROM (SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0)) AS pages FROM jobs_v WHERE {PUB} AND company = 'BUILDING')", "jobs_v")
def search_total(spark, sf_dir):
    t = serve.total_matches(view(spark, sf_dir, "jobs_v"), company="building")
    return t.select("total", serve.page_clamp(F.col("total"), 900000, 20).alias("p")).select("total", "p.page", "p.page_count")


@query(f"SELECT id, title, company, city, state, relevance, posted_at FROM jobs_v WHERE {PUB}", "jobs_v")
def job_summaries(spark, sf_dir):
    return serve.published(view(spark, sf_dir, "jobs_v")).select("id", "title", "company", "city", "state", "relevance", "posted_at")


@query(f"SELECT DISTINCT company FROM jobs_v WHERE {PUB}", "jobs_v")
def companies(spark, sf_dir):
    return serve.published_companies(view(spark, sf_dir, "jobs_v"))


@query(f"SELECT count(*) FILTER (structure_status <> 'ready') AS n FROM jobs_v WHERE {PUB}", "jobs_v")
def unstructured(spark, sf_dir):
    return serve.unstructured_count(view(spark, sf_dir, "jobs_v"))


SUMS = ", ".join(f"coalesce(sum({c}_count), 0)::BIGINT AS {c}" for c in ("fetched", "inserted", "updated", "rejected"))


@query(f"SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, {SUMS} FROM runs_v", "runs_v")
def crawl_totals(spark, sf_dir):
    return serve.crawl_totals(view(spark, sf_dir, "runs_v"))


@query(
    "SELECT * FROM (SELECT count(*) AS jobs, " + ", ".join(f"count(*) FILTER (relevance = '{x}') AS relevance_{x}" for x in ("india", "remote_india", "not_india", "unknown_remote", "unknown"))
    + f", count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'expired') AS expired FROM jobs_v), (SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled FROM sources_v), (SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, {SUMS} FROM runs_v)",
    "jobs_v", "sources_v", "runs_v",
)
def stats(spark, sf_dir):
    return serve.stats(view(spark, sf_dir, "jobs_v"), view(spark, sf_dir, "sources_v"), view(spark, sf_dir, "runs_v"))


@query("SELECT run_id, started_at, source_id, source_type, external_key FROM (SELECT * FROM runs_v WHERE failed ORDER BY started_at DESC, run_id LIMIT 20) r JOIN sources_v s ON r.source_id = s.id", "runs_v", "sources_v")
def recent_failures(spark, sf_dir):
    return serve.recent_failures(view(spark, sf_dir, "runs_v"), view(spark, sf_dir, "sources_v")).select("run_id", "started_at", "source_id", "source_type", "external_key")


@query("SELECT source_id, run_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id) AS rn FROM runs_v) WHERE rn <= 5", "runs_v")
def runs_topk(spark, sf_dir):
    return serve.recent_runs(view(spark, sf_dir, "runs_v"), 5).select("source_id", "run_id", "rn")


@query("SELECT o.id, coalesce(nullif(trim(s.company_name), ''), s.name) AS source_name FROM jobs_v o LEFT JOIN sources_v s ON o.id % 7 = s.id", "jobs_v", "sources_v")
def jobs_with_source(spark, sf_dir):
    j = view(spark, sf_dir, "jobs_v").withColumn("canonical_source_id", F.col("id") % 7)
    return serve.job_with_source(j, view(spark, sf_dir, "sources_v")).select("id", "source_name")


@query("SELECT time_bucket(INTERVAL '6 hours', started_at, TIMESTAMP '1970-01-01') AS window_start, source_id, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed, sum(fetched_count)::BIGINT AS fetched FROM runs_v GROUP BY 1, 2", "runs_v")
def crawl_windows(spark, sf_dir):
    from tidewell.streaming.stream import windowed_crawl_totals

    return windowed_crawl_totals(view(spark, sf_dir, "runs_v"))


# --- sync ----------------------------------------------------------------------------------------------------------------


def _sendable_jobs(spark, sf_dir):
    key = F.when(F.col("id") % 13 == 0, "other").otherwise(F.col("exact_fingerprint"))
    payload = F.struct(key.alias("external_key"), F.col("company_normalized").alias("company_external_key"), F.col("company").alias("company_name"), "title", F.lit("https://x").alias("apply_url"))
    return view(spark, sf_dir, "jobs_v").withColumn("payload", payload)


POSTABLE = f"+ po AS (SELECT * FROM jobs_v WHERE {PUB} AND structure_status = 'ready' AND id % 13 <> 0), wa AS (SELECT * FROM po WHERE exact_fingerprint NOT IN (SELECT external_key FROM acks_v WHERE target = 'a'))\n"


@query(POSTABLE + """, n AS (SELECT company_normalized AS k, trim(company_name) AS name, count(*) AS n FROM wa GROUP BY 1, 2), nn AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY n DESC, lower(name)) AS i FROM n),
l AS (SELECT company_normalized AS k, left(concat_ws(', ', city, state, country_code), 180) AS p, row_number() OVER (PARTITION BY company_normalized ORDER BY posted_at DESC NULLS LAST, id) AS i FROM wa)
SELECT nn.k AS external_key, name, p AS primary_location, TRUE AS publish FROM nn LEFT JOIN l ON nn.k = l.k AND l.i = 1 WHERE nn.i = 1""", "jobs_v", "acks_v")
def company_payloads(spark, sf_dir):
    waiting = sync.unsynced(sync.postable(_sendable_jobs(spark, sf_dir)), view(spark, sf_dir, "acks_v"), "a")
    return sync.company_payloads(waiting, True)


@query(POSTABLE + "SELECT id, company_normalized, posted_at FROM po", "jobs_v", "acks_v")
def postable_rows(spark, sf_dir):
    """Jobs that can be sent, in the order in which they are."""
    return sync.postable_ordered(_sendable_jobs(spark, sf_dir)).select("id", "company_normalized", "posted_at")


@query(POSTABLE + "SELECT count(*) AS waiting FROM wa", "jobs_v", "acks_v")
def waiting(spark, sf_dir):
    return sync.waiting_count(sync.postable(_sendable_jobs(spark, sf_dir)), view(spark, sf_dir, "acks_v"), "a")


@query(POSTABLE + """, f AS (SELECT *, row_number() OVER (PARTITION BY exact_fingerprint ORDER BY company_normalized, posted_at DESC NULLS LAST, id) AS i FROM wa), g AS (SELECT id, row_number() OVER (ORDER BY company_normalized, posted_at DESC NULLS LAST, id) AS n FROM f WHERE i = 1)
SELECT id, CAST(ceil(n / 40.0) AS INT) AS batch_no, CAST((n - 1) % 40 AS INT) AS pos FROM g""", "jobs_v", "acks_v")
def sync_batches(spark, sf_dir):
    plan = sync.transfer_plan(_sendable_jobs(spark, sf_dir), view(spark, sf_dir, "acks_v"), "a")
    return plan["jobs"].select("id", "batch_no", "pos")


@query(POSTABLE + "SELECT * FROM acks_v WHERE target <> 'a' OR external_key IN (SELECT exact_fingerprint FROM po)", "jobs_v", "acks_v")
def forget_stale(spark, sf_dir):
    return sync.transfer_plan(_sendable_jobs(spark, sf_dir), view(spark, sf_dir, "acks_v"), "a")["acks"]


@query(POSTABLE + "SELECT DISTINCT exact_fingerprint AS external_key FROM po", "jobs_v", "acks_v")
def reconcile_set(spark, sf_dir):
    return sync.transfer_plan(_sendable_jobs(spark, sf_dir), view(spark, sf_dir, "acks_v"), "a")["reconcile"]


@query("SELECT external_key FROM acks_v WHERE target = 'b'", "acks_v")
def deactivate_set(spark, sf_dir):
    acks = view(spark, sf_dir, "acks_v")
    return sync.deactivate_set(acks.where("false"), acks, "b")


@query("SELECT target, external_key FROM acks_v UNION SELECT 'a', 'fp' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0", "acks_v")
def remember_acks(spark, sf_dir):
    fresh = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.lit("a").alias("target"), F.concat(F.lit("fp"), "o_orderkey").alias("external_key"))
    return sync.remember(view(spark, sf_dir, "acks_v"), fresh)


@query("SELECT name, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'click' THEN ['created'] WHEN 'view' THEN ['updated'] WHEN 'error' THEN ['skipped', 'bad'] ELSE ['skipped'] END) AS name FROM events) GROUP BY 1")
def action_tallies(spark, sf_dir):
    kind = F.col("event_type")
    r = table(spark, sf_dir, "events").select(F.when(kind == "click", "created").when(kind == "view", "updated").when(kind == "error", "skipped").otherwise("odd").alias("action"), F.when(kind == "error", "bad").alias("reason"))
    return sync.action_tallies(r)


@query(POSTABLE + """, f AS (SELECT *, row_number() OVER (PARTITION BY exact_fingerprint ORDER BY company_normalized, posted_at DESC NULLS LAST, id) AS i FROM wa), g AS (SELECT exact_fingerprint, row_number() OVER (ORDER BY company_normalized, posted_at DESC NULLS LAST, id) AS n FROM f WHERE i = 1)
SELECT 'a' AS target, exact_fingerprint AS external_key, CASE (n - 1) % 40 % 3 WHEN 0 THEN 'created' ELSE 'updated' END AS action FROM g WHERE (n - 1) % 40 % 3 < 2""", "jobs_v", "acks_v")
def acked(spark, sf_dir):
    sent = sync.transfer_plan(_sendable_jobs(spark, sf_dir), view(spark, sf_dir, "acks_v"), "a")["jobs"]
    results = sent.select("batch_no", "pos").select("batch_no", "pos", F.when(F.col("pos") % 3 == 0, "created").when(F.col("pos") % 3 == 1, "updated").otherwise("skipped").alias("action"))
    return sync.ack_results(sent, results, "a")


# --- structuring, end to end -------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, classified, collapsed to one job a fingerprint, and the first page of a search over them."""
    c = resolve.with_identity(view(spark, sf_dir, "candidates_v"))
    c = c.withColumn("relevance", geo.classify_relevance(F.array("location"), "title", "description"))
    kept, _ = resolve.reject_not_relevant(c)
    jobs = resolve.collapse(kept, "fingerprint", "candidate_id").select(
        F.col("candidate_id").alias("id"), "title", F.col("company_name").alias("company"), "location", "relevance", F.lit("active").alias("status"),
        F.lit(None).cast("timestamp").alias("posted_at"), "description",
    )
    return serve.search_jobs(jobs).select("id", "title", "company", "location", "relevance")


@query("SELECT id, source_type, external_key, name, company_name, enabled FROM sources_v ORDER BY source_type, external_key", "sources_v")
def source_list(spark, sf_dir):
    return serve.list_sources(view(spark, sf_dir, "sources_v")).select("id", "source_type", "external_key", "name", "company_name", "enabled")


@query("SELECT id, source_type, external_key, name, company_name, enabled, crawl_interval_minutes, next_crawl_at, CAST(NULL AS TIMESTAMP) AS last_success_at, id % 5 AS consecutive_failures FROM sources_v", "sources_v")
def source_summaries(spark, sf_dir):
    s = view(spark, sf_dir, "sources_v").withColumns({"last_success_at": F.lit(None).cast("timestamp"), "consecutive_failures": F.col("id") % 5, "base_url": F.lit("not shown")})
    return serve.source_summary(s)


@query("SELECT run_id, source_id, started_at, finished_at, status, fetched_count, inserted_count, updated_count, rejected_count, error_text FROM runs_v", "runs_v")
def run_list(spark, sf_dir):
    return serve.run_summary(view(spark, sf_dir, "runs_v"))


@query("SELECT source_type, external_key FROM sources_v WHERE id % 3 <> 0", "sources_v")
def unsaved_boards(spark, sf_dir):
    s = view(spark, sf_dir, "sources_v")
    return raw.candidates_not_saved(s.select("source_type", "external_key"), s.where("id % 3 = 0"))


PROBE = """+ e AS (SELECT 'lever' AS source_type, source AS k, CASE WHEN source = 'src3' THEN 'https://else/1' ELSE 'https://jobs.lever.co/' || source || '/' || doc_id END AS u, doc_id % 2 = 0 AS pub FROM documents)
SELECT source_type, k AS external_key, k AS name, count(*) AS job_count, count(*) FILTER (pub) AS published_count FROM e GROUP BY 1, 2 HAVING bool_and(starts_with(u, 'https://jobs.lever.co/' || k || '/'))"""


@query("WITH " + PROBE.lstrip("+ "))
def board_probe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.when(F.col("source") == "src3", "https://else/1").otherwise(F.concat(F.lit("https://jobs.lever.co/"), "source", F.lit("/"), "doc_id"))
    env = d.select(F.lit("lever").alias("source_type"), F.col("source").alias("source_external_key"), url.alias("source_url"), F.lit(None).cast("string").alias("payload_company"), F.when(F.col("doc_id") % 2 == 0, "india").otherwise("unknown").alias("relevance"))
    boards = d.select(F.lit("lever").alias("source_type"), F.col("source").alias("external_key"), F.col("source").alias("name"), F.col("source").alias("company_name")).distinct()
    return serve.board_probe(boards, env.withColumnRenamed("source_external_key", "external_key"), raw.source_rejections(boards, env))


@query("SELECT status, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'expired' ELSE 'active' END AS status FROM orders) GROUP BY 1")
def status_counts(spark, sf_dir):
    wide = serve.count_by_status(view(spark, sf_dir, "jobs_v"))
    return wide.select(F.inline(F.array(F.struct(F.lit("active").alias("status"), F.col("active").alias("n")), F.struct(F.lit("expired").alias("status"), F.col("expired").alias("n")))))


@query()
def published_batch(spark, sf_dir):
    """Board responses through normalising, relevance, resolution and publishing, from empty tables: the jobs they make."""
    from .publish import JOBS, LINKS, publish

    e = _all_envelopes(spark, sf_dir)
    sources = e.select("source_type", "source_external_key", F.col("source_external_key").alias("company_name")).distinct()
    good, _ = normalize.normalize_with_quarantine(e, sources)
    out = publish(good, spark.createDataFrame([], JOBS), spark.createDataFrame([], LINKS))
    return out["jobs"].select("job_id", "title", "company_name", "location", "relevance", "status")

"""Board responses and pages to raw envelopes: one row per posting, the payload kept whole as a variant.

Input frames are landed documents: (source_type, source_external_key, fetched_at, body) for boards, (url, html, ...) for pages.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.facts import _string
from tidewell.functions.text import by_slices, hash_payload, unescape
from tidewell.operators.asof import asof_join

COLUMNS = ("source_type", "source_external_key", "source_job_id", "source_url", "fetched_at", "payload")


def text_at(v: Column | str, path: str) -> Column:
    """The value at a path if it is a string."""
    return _string(F.col(v) if isinstance(v, str) else v, path)


def trimmed_at(v: Column | str, path: str) -> Column:
    return F.nullif(F.trim(text_at(v, path)), F.lit(""))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _shaped(df: DataFrame, job_id: Column, url: Column) -> DataFrame:
    return df.withColumns({"source_job_id": job_id, "source_url": url}).where("source_job_id is not null").select(*COLUMNS)


def envelopes_boards(responses: DataFrame) -> DataFrame:
    """One row per posting of the four kinds of boards, by the response's ``source_type``: one pass, each body parsed once."""
    kind = F.col("source_type")
    items = F.when(kind == "lever", F.from_json("body", "array<variant>")).otherwise(F.from_json("body", "jobs array<variant>")["jobs"])
    rows = responses.where(kind.isin("greenhouse", "lever", "ashby", "workable")).withColumn("payload", F.explode(items)).where(_is_object(F.col("payload")))
    code = F.coalesce(trimmed_at("payload", "$.shortcode"), trimmed_at("payload", "$.code"))
    job_id = F.when(kind == "workable", code).otherwise(F.try_variant_get("payload", "$.id", "string"))
    url = (
        F.when(kind == "greenhouse", text_at("payload", "$.absolute_url")).when(kind == "lever", text_at("payload", "$.hostedUrl"))
        .when(kind == "ashby", text_at("payload", "$.jobUrl")).otherwise(F.coalesce(text_at("payload", "$.url"), text_at("payload", "$.shortlink")))
    )
    return _shaped(rows, job_id, url)


def _of(kind: str, responses: DataFrame) -> DataFrame:
    return envelopes_boards(responses.withColumn("source_type", F.lit(kind)))


def envelopes_greenhouse(responses: DataFrame) -> DataFrame:
    return _of("greenhouse", responses)


def envelopes_lever(responses: DataFrame) -> DataFrame:
    return _of("lever", responses)


def envelopes_ashby(responses: DataFrame) -> DataFrame:
    return _of("ashby", responses)


def envelopes_workable(responses: DataFrame) -> DataFrame:
    return _of("workable", responses)


def account_name_check(responses: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) responses: the response's own name must equal the expected company, where one is expected."""
    named = responses.withColumn("account_name", F.trim(F.from_json("body", "name string")["name"]))
    expected = sources.select("source_type", "source_external_key", F.nullif(F.trim("company_name"), F.lit("")).alias("expected"))
    both = named.join(expected, ["source_type", "source_external_key"], "left")
    good = F.col("expected").isNull() | F.coalesce(F.col("account_name") == F.col("expected"), F.lit(False))
    return both.where(good).select(responses.columns), both.where(~good).select(*responses.columns, F.lit("account name differs").alias("error"))


#: What Python's patterns call white space and the end of a word, in Java's words.
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
LD_JSON = rf"(?isu)<script(?![\p{{L}}\p{{N}}_])[^>]*type{_WS}={_WS}[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script{_WS}>"


def is_job_posting(kind) -> bool:
    """Whether a type, or any in a list of types at whatever depth, is JobPosting: its last part after a slash decides."""
    if isinstance(kind, list):
        return any(map(is_job_posting, kind))
    return isinstance(kind, str) and kind.rstrip("/").split("/")[-1] == "JobPosting"


def _no_number(text: str) -> None:
    raise ValueError(text)


def block_postings(blocks: list[str]) -> list[str]:
    """The JSON of every object of type JobPosting in a page's ld+json blocks, at whatever depth; a type may be a whole URL."""
    found = []
    for block in blocks:
        try:
            open_ = [json.loads(block, parse_constant=_no_number)]
            while open_:
                x = open_.pop()
                if isinstance(x, dict):
                    if is_job_posting(x.get("@type")):
                        found.append(json.dumps(x))
                    open_ += reversed(x.values())
                elif isinstance(x, list):
                    open_ += reversed(x)
        except (ValueError, RecursionError):
            continue
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def _block_postings(blocks: pa.Array) -> pa.Array:
    return by_slices(blocks, lambda pages: [x and block_postings(x) for x in pages], pa.list_(pa.string()))


def ld_postings(html: Column | str) -> Column:
    """The postings of a page; its blocks are cut out where it is, so that only they leave the JVM."""
    blocks = F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))
    return F.coalesce(_block_postings(blocks), F.array().cast("array<string>"))


def extract_jsonld_postings(pages: DataFrame) -> DataFrame:
    """Every nested object of type JobPosting in the page's ld+json blocks: ``pages`` columns with ``payload``.

    Blocks that are no JSON are skipped. Pages are read and their blocks parsed once, whatever the depth of a posting.
    """
    found = pages.withColumn("payload", F.explode(ld_postings("html")))
    return found.withColumn("payload", F.try_parse_json("payload")).where("payload is not null")


def envelopes_jsonld(pages: DataFrame) -> DataFrame:
    """One envelope per posting of each page; the id is the first of identifier, its value, @id, url, payload hash."""
    rows = extract_jsonld_postings(pages)
    value = F.nullif(F.trim(F.try_variant_get("payload", "$.identifier.value", "string")), F.lit(""))
    job_id = F.coalesce(
        trimmed_at("payload", "$.identifier"), value, trimmed_at("payload", "$['@id']"), trimmed_at("payload", "$.url"), hash_payload("payload")
    )
    return _shaped(rows.withColumn("source_type", F.lit("generic-jsonld")), job_id, F.col("url"))


def sitemap_expand(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, url, html): pages reached from each root URL, through a sitemap and one nested level of sitemaps.

    ``pages`` holds fetched documents (url, html, content_type). A root that is no sitemap is its own page. Of the locations in a
    root's sitemap those whose path ends in ``.xml`` are read as sitemaps, and passed over where they are none; all others are
    pages, whatever they hold. Locations that were not fetched are passed over.
    """
    path = F.lower(F.substring_index("url", "?", 1))
    sample = F.lower(F.substring(F.ltrim("html"), 1, 200))
    by_type = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("xml")) & F.lower(F.try_parse_url("url", F.lit("PATH"))).endswith(".xml")
    is_map = F.contains(sample, F.lit("<urlset")) | F.contains(sample, F.lit("<sitemapindex")) | (by_type & F.contains(F.lower("html"), F.lit("<loc")))
    known = pages.select("url", "html", F.coalesce(is_map, F.lit(False)).alias("is_map"))
    locs = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u))
    listed = lambda maps: maps.select("root", F.explode(locs).alias("url")).withColumn("url", unescape("url")).distinct()
    reached = roots.select(F.col("url").alias("root"), "url").join(known, "url")
    first = listed(reached.where("is_map")).withColumn("nested", path.endswith(".xml")).join(known, "url")
    second = listed(first.where("nested and is_map")).join(known, "url")
    found = [reached.where("not is_map"), first.where("not nested"), second]
    return reduce(DataFrame.unionByName, [x.select("root", "url", "html") for x in found]).dropDuplicates(["root", "url"])


#: The answers to a request for robots rules that settle the matter; after any other the last such one holds.
SETTLED, ALLOWS_ALL, DISALLOWS_ALL = (200, 401, 403, 404, 410), (404, 410), (401, 403)


def url_admission(urls: DataFrame, snapshots: DataFrame, fresh_hours: int = 24) -> DataFrame:
    """``urls`` (url, at) with ``allowed`` by the newest robots snapshot of the origin at that time, one row a url and time.

    ``snapshots``: (origin, fetched_at, status, rules array<struct<rule_no, allow, prefix>>). A snapshot up to ``fresh_hours`` old
    is used; an older one only where no newer exists (``stale``). 404 and 410 allow, 401 and 403 disallow; with 200 the first rule
    whose prefix begins the path decides, and none allows. Any other status is no answer: the snapshot before it counts. No
    snapshot at all: not allowed.
    """
    origin = F.concat(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("url", F.lit("AUTHORITY")))
    asked = urls.select("url", "at", origin.alias("origin")).distinct()
    newest = asof_join(asked, snapshots.where(F.col("status").isin(*SETTLED)), "origin", "at", "fetched_at", ("status", "rules"), ties=("status",))
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    ordered = F.array_sort(F.filter("asof.rules", lambda r: path.startswith(r["prefix"])))
    by_rule = F.coalesce(F.get(ordered, 0)["allow"], F.lit(True))
    status = F.col("asof.status")
    allowed = F.when(status.isNull(), False).when(status.isin(*ALLOWS_ALL), True).when(status.isin(*DISALLOWS_ALL), False).otherwise(by_rule)
    stale = F.col("asof.fetched_at") < F.col("at") - F.make_dt_interval(hours=F.lit(fresh_hours))
    return newest.select("url", "at", allowed.alias("allowed"), F.coalesce(stale, F.lit(False)).alias("stale"))

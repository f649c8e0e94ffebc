"""Which board system a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import _col

from .envelopes import ld_postings

# Hosts of the boards (these and the ones in ``classify_host``), what a board's key looks like, where a URL ends.
URL = r"(?i)https?://[^\s\"'<>]+"
GREENHOUSE_HOST = r"^(job-boards(\.eu)?|boards-api|boards)\.greenhouse\.io$"
SLUG = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,80}$"


def extract_urls(page_url: Column | str, html: Column | str) -> Column:
    """The page's own URL, then every URL of its HTML, in order."""
    return F.concat(F.array(_col(page_url)), F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(URL), F.lit(0)))


def url_host(url: Column | str) -> Column:
    authority = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.substring_index(F.substring_index(authority, "@", -1), ":", 1))


def url_path(url: Column | str) -> Column:
    path = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"\?([^#]*)", 1)


def classify_host(host: Column) -> Column:
    return (
        F.when(host.rlike(GREENHOUSE_HOST), "greenhouse")
        .when(host == "jobs.lever.co", "lever")
        .when(host == "jobs.ashbyhq.com", "ashby")
        .when((host == "workable.com") | host.endswith(".workable.com"), "workable")
    )


def classify_url(url: Column | str) -> Column:
    return classify_host(url_host(url))


def slug(c: Column) -> Column:
    return F.when(c.rlike(SLUG), c)


def board_key(url: Column | str) -> Column:
    host, path, query = url_host(url), url_path(url), url_query(url)
    first = F.get(path, 0)
    after = F.get(path, F.array_position(path, "boards").cast("int"))  # positions count from 1, so this is the next one
    named = F.nullif(F.regexp_extract(query, r"(?:^|&)for=([^&]*)", 1), F.lit(""))
    named = F.coalesce(F.try_url_decode(named), named)
    greenhouse = (
        F.when(F.array_contains(path, "boards") & after.isNotNull(), slug(after))
        .when(named.isNotNull(), slug(named))
        .when(~first.isin("v1", "embed", "jobs"), slug(first))
    )
    labels = F.split(host, r"\.")
    own = (F.size(labels) > 2) & ~F.get(labels, 0).isin("www", "apply", "api")
    workable = F.when(host == "apply.workable.com", slug(first)).when(own, slug(F.get(labels, 0))).otherwise(slug(first))
    kind = classify_host(host)
    return F.when(kind == "greenhouse", greenhouse).when(kind.isin("lever", "ashby"), slug(first)).when(kind == "workable", workable)


def has_job_posting(html: Column | str) -> Column:
    """An ld+json block with an object of type JobPosting."""
    return F.size(ld_postings(_col(html))) > 0


def detect(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, status, source_type, external_key, evidence): one row per page."""
    hits = (
        pages.select(F.col(key), F.posexplode(extract_urls(url, html)).alias("pos", "hit"))
        .select(key, "pos", "hit", classify_url("hit").alias("kind"))
        .where("kind is not null")
        .withColumn("board", board_key("hit"))
    )
    sums = hits.groupBy(key).agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("board")).alias("boards"), F.min_by("hit", "pos").alias("first_hit")
    )
    both = pages.select(key, has_job_posting(html).alias("ld")).join(sums, key, "left")
    n_kinds, n_boards = F.coalesce(F.size("kinds"), F.lit(0)), F.coalesce(F.size("boards"), F.lit(0))
    none = F.col("kinds").isNull()
    many = ~none & (n_kinds > 1)
    torn = ~none & (n_kinds == 1) & (n_boards > 1)
    good = ~none & (n_kinds == 1) & (n_boards <= 1)
    return both.select(
        key,
        F.when(good | (none & F.col("ld")), "detected").otherwise("needs-review").alias("status"),
        F.when(good, F.get("kinds", 0)).when(none & F.col("ld"), "generic-jsonld").alias("source_type"),
        F.when(good, F.get("boards", 0)).alias("external_key"),
        F.when(many, F.concat(F.lit("multiple ATS matches: "), F.array_join("kinds", ", ")))
        .when(torn, F.concat(F.lit("multiple "), F.get("kinds", 0), F.lit(" keys: "), F.array_join("boards", ", ")))
        .when(good, F.col("first_hit"))
        .when(F.col("ld"), "schema.org JobPosting JSON-LD")
        .otherwise("no supported ATS or JobPosting JSON-LD").alias("evidence"),
    )


def parse_board(board: Column | str, source_type: Column | str) -> Column:
    """struct(source_type, external_key) of a board URL, or of a type and a key; nulls where it is neither."""
    text, kind = F.trim(_col(board)), F.lower(F.trim(_col(source_type)))
    is_url = text.rlike("^https?://")
    listed = kind.isin("greenhouse", "lever", "ashby", "workable") & text.rlike(SLUG)
    key = F.when(is_url, board_key(text)).when(listed, text)
    return F.struct(F.when(key.isNotNull(), F.when(is_url, classify_url(text)).otherwise(kind)).alias("source_type"), key.alias("external_key"))


def board_url(source_type: Column | str, key: Column | str) -> Column:
    kind = _col(source_type)
    base = (
        F.when(kind == "greenhouse", "https://job-boards.greenhouse.io/").when(kind == "lever", "https://jobs.lever.co/")
        .when(kind == "ashby", "https://jobs.ashbyhq.com/").otherwise("https://apply.workable.com/")
    )
    return F.concat(base, _col(key))

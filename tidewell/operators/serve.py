"""Search, statistics and projections over the job, source and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import blank_to_null, contains_text

JOB_SUMMARY = ("id", "title", "company", "city", "state", "country", "work_mode", "employment_type", "relevance", "posted_at", "apply_url")
JOB_DETAIL = (*JOB_SUMMARY, "description", "first_seen_at", "last_seen_at")
SOURCE_SUMMARY = (
    "id", "source_type", "external_key", "name", "company_name", "enabled", "crawl_interval_minutes", "next_crawl_at", "last_success_at", "consecutive_failures",
)
RUN_SUMMARY = ("run_id", "source_id", "started_at", "finished_at", "status", "fetched_count", "inserted_count", "updated_count", "rejected_count", "error_text")


def published(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == "active") & F.col("relevance").isin(*fixed.PUBLISHED))


def _matching(jobs: DataFrame, q: str | None = None, **equals: str | None) -> DataFrame:
    rows = published(jobs)
    for column, value in equals.items():
        if value and value.strip():
            rows = rows.where(F.lower(column) == value.strip().lower())
    if q and q.strip():
        needle = q.strip()
        rows = rows.where(contains_text("title", needle) | contains_text("company", needle) | F.coalesce(contains_text("description", needle), F.lit(False)))
    return rows


def search_jobs(jobs: DataFrame, page: int = 1, size: int = 20, q: str | None = None, **equals: str | None) -> DataFrame:
    """One page of published jobs, newest first (none last), then by id. Sort and limit meet in a top-k, not a full sort."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page is from 1, size from 1 to 100")
    return _matching(jobs, q, **equals).orderBy(F.desc_nulls_last("posted_at"), "id").offset((page - 1) * size).limit(size)


def total_matches(jobs: DataFrame, q: str | None = None, **equals: str | None) -> DataFrame:
    return _matching(jobs, q, **equals).agg(F.count("*").alias("total"))


def page_clamp(total: Column, page: int, size: int) -> Column:
    """struct(page, page_count): a page past the end is the last one; there is at least one."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
    return F.struct(F.least(F.lit(page), pages).alias("page"), pages.alias("page_count"))


def get_job(jobs: DataFrame, job_id) -> DataFrame:
    return published(jobs).where(F.col("id") == job_id)


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB_SUMMARY)


def job_detail(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB_DETAIL)


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_type", "external_key")


def source_summary(sources: DataFrame) -> DataFrame:
    return sources.select(*SOURCE_SUMMARY)


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.select(*RUN_SUMMARY)


def job_with_source(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with the shown name of their canonical source."""
    names = sources.select(F.col("id").alias("canonical_source_id"), F.coalesce(blank_to_null("company_name"), F.col("name")).alias("source_name"))
    return jobs.join(names, "canonical_source_id", "left")


def count_by(jobs: DataFrame, column: str) -> DataFrame:
    return jobs.groupBy(column).agg(F.count("*").alias("n"))


def count_by_status(jobs: DataFrame) -> DataFrame:
    """One row: active and expired, 0 where there is none."""
    return jobs.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "expired").alias("expired"))


def crawl_totals(runs: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("_count", "")) for c in ("fetched_count", "inserted_count", "updated_count", "rejected_count")]
    return runs.agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), *sums
    )


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


def stats(jobs: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """All counts in one row; each side is one row before they are put together."""
    labels = ("india", "remote_india", "not_india", "unknown_remote", "unknown")
    j = jobs.agg(
        F.count("*").alias("jobs"), *[F.count_if(F.col("relevance") == x).alias(f"relevance_{x}") for x in labels],
        F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "expired").alias("expired"),
    )
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(j).join(one(source_counts(sources)), "_k").join(one(crawl_totals(runs)), "_k").drop("_k")


def published_companies(jobs: DataFrame) -> DataFrame:
    return published(jobs).select("company").distinct().orderBy("company")


def unstructured_count(jobs: DataFrame) -> DataFrame:
    return published(jobs).agg(F.count_if(F.coalesce(F.col("structure_status") != "ready", F.lit(True))).alias("n"))


def recent_failures(runs: DataFrame, sources: DataFrame, limit: int = 20) -> DataFrame:
    """The newest failed runs beside their source."""
    failed = runs.where("status = 'failed'").orderBy(F.desc("started_at"), "run_id").limit(limit)
    return failed.join(sources.select(F.col("id").alias("source_id"), "source_type", "external_key"), "source_id")


def recent_runs(runs: DataFrame, k: int = 20) -> DataFrame:
    """The newest k runs of every source. The rank is a top-k a group, so Spark trims each task's rows before the shuffle."""
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), "run_id")
    return runs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def board_probe(boards: DataFrame, envelopes: DataFrame, rejections: DataFrame) -> DataFrame:
    """(source_type, external_key, name, job_count, published_count) of boards that pass, most published first, then by name."""
    key = ["source_type", "external_key"]
    counts = envelopes.groupBy(*key).agg(F.count("*").alias("job_count"), F.count_if(F.col("relevance").isin(*fixed.PUBLISHED)).alias("published_count"))
    good = boards.join(rejections.where("reason is null").select(*key), key, "left_semi")
    return good.join(counts, key).select(*key, "name", "job_count", "published_count").orderBy(F.desc("published_count"), "name")

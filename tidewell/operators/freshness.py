"""Seen and missing postings, crawl outcomes and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import fixed


def seen_join(links: DataFrame, seen: DataFrame) -> DataFrame:
    ids = seen.select("source_id", "source_job_id").distinct().withColumn("seen", F.lit(True))
    return links.join(ids, ["source_id", "source_job_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def apply_source_crawl(links: DataFrame, seen: DataFrame, crawled: DataFrame) -> DataFrame:
    """New links after successful crawls of ``crawled`` sources (source_id); links of other sources stay as they are.

    A seen link is active and not missing; an active unseen one counts a miss and ends at two; an inactive unseen one stays.
    """
    done = crawled.select("source_id").distinct().withColumn("_done", F.lit(True))
    rows = seen_join(links, seen).join(done, "source_id", "left")
    hit, miss = F.col("_done") & F.col("seen"), F.coalesce(F.col("_done") & ~F.col("seen") & F.col("active"), F.lit(False))
    count = F.when(hit, 0).when(miss, F.col("missing_count") + 1).otherwise(F.col("missing_count"))
    active = F.when(hit, True).when(miss, count < fixed.MISSES_TO_EXPIRE).otherwise(F.col("active"))
    return rows.select(*[{"missing_count": count.alias("missing_count"), "active": active.alias("active")}.get(c, F.col(c)) for c in links.columns])


def crawl_history_state(crawls: DataFrame, seen: DataFrame) -> DataFrame:
    """(source_id, source_job_id, missing_count, active) after a whole history at once.

    ``crawls``: (source_id, seq) of successful crawls; ``seen``: (source_id, source_job_id, seq). The misses are the successful
    crawls since a posting was last seen, two at most.
    """
    order = Window.partitionBy("source_id").orderBy("seq")
    numbered = crawls.select("source_id", "seq").distinct().withColumn("n", F.row_number().over(order))
    last = numbered.groupBy("source_id").agg(F.max("n").alias("crawls"))
    states = seen.join(numbered, ["source_id", "seq"]).groupBy("source_id", "source_job_id").agg(F.max("n").alias("last_seen"))
    missing = F.least(F.lit(fixed.MISSES_TO_EXPIRE), F.col("crawls") - F.col("last_seen")).cast("int")
    return states.join(last, "source_id").select("source_id", "source_job_id", missing.alias("missing_count"), (missing < fixed.MISSES_TO_EXPIRE).alias("active"))


def status_for_associations(links: DataFrame) -> DataFrame:
    """(job_id, status): active while any link is."""
    return links.groupBy("job_id").agg(F.when(F.bool_or("active"), "active").otherwise("expired").alias("status"))


def affected_jobs(links: DataFrame, crawled: DataFrame) -> DataFrame:
    return links.join(crawled.select("source_id").distinct(), "source_id", "left_semi").select("job_id").distinct()


def finalize_source_freshness(jobs: DataFrame, links: DataFrame, seen: DataFrame, crawled: DataFrame, checked_at) -> tuple[DataFrame, DataFrame]:
    """(jobs, links) after a crawl: link states, then status and times of the jobs that these sources touch, from all their links."""
    new_links = apply_source_crawl(links, seen, crawled)
    touched = affected_jobs(links, crawled)
    rows = seen_join(new_links, seen).join(touched, "job_id", "left_semi")
    states = rows.groupBy("job_id").agg(F.when(F.bool_or("active"), "active").otherwise("expired").alias("_status"), F.bool_or("seen").alias("_seen"))
    at = F.lit(checked_at).cast("timestamp")
    both = jobs.join(states, "job_id", "left")
    made = {
        "status": F.coalesce("_status", "status").alias("status"),
        "last_checked_at": F.when(F.col("_status").isNotNull(), at).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        "last_seen_at": F.when(F.col("_seen"), at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    }
    return both.select(*[made.get(c, F.col(c)) for c in jobs.columns]), new_links


def crawl_outcome(rows: DataFrame) -> DataFrame:
    """(source_id, fetched, inserted, updated, rejected). ``rows``: source_id, is_new, error (no connector, bad payload, elsewhere)."""
    return rows.groupBy("source_id").agg(
        F.count("*").alias("fetched_count"), F.count_if("is_new").alias("inserted_count"), F.count_if(~F.col("is_new")).alias("updated_count"),
        F.count_if(F.col("error").isNotNull()).alias("rejected_count"),
    )


def interval_minutes(source_type: Column | str, configured: Column | str) -> Column:
    kind = F.col(source_type) if isinstance(source_type, str) else source_type
    given = F.col(configured) if isinstance(configured, str) else configured
    return (
        F.when(kind.isin(*fixed.SLOW_TYPES), F.greatest(F.coalesce(given, F.lit(0)), F.lit(fixed.SLOW_INTERVAL)))
        .when(given.isNotNull(), given)
        .when(kind.isin(*fixed.EMPLOYER_SOURCES), fixed.DEFAULT_INTERVAL)
        .otherwise(fixed.SLOW_INTERVAL)
    )


def next_crawl(source_type: Column | str, configured: Column | str, checked_at: Column | str) -> Column:
    at = F.col(checked_at) if isinstance(checked_at, str) else checked_at
    return at + F.make_dt_interval(mins=interval_minutes(source_type, configured))


def is_due(now: Column) -> Column:
    return F.col("enabled") & (F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= now))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    return sources.where(is_due(now)).orderBy(F.asc_nulls_first("next_crawl_at"))


def finish_crawls(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """New source snapshot after one run a source (source_id, status, http_status, error_text, checked_at).

    Success clears failures; a failure counts up and, on 403 or 404, disables with the reason; both set the next crawl.
    """
    r = runs.select(F.col("source_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("status", "http_status", "error_text", "checked_at")])
    both = sources.join(r, "id", "left")
    ran, good = F.col("_status").isNotNull(), F.coalesce(F.col("_status") == "success", F.lit(False))
    gone = ran & ~good & F.coalesce(F.col("_http_status").isin(403, 404), F.lit(False))
    made = {
        "consecutive_failures": F.when(good, 0).when(ran, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures")),
        "enabled": F.when(gone, False).otherwise(F.col("enabled")),
        "disabled_reason": F.when(gone, F.col("_error_text")).otherwise(F.col("disabled_reason")),
        "last_success_at": F.when(good, F.col("_checked_at")).otherwise(F.col("last_success_at")),
        "last_crawl_at": F.coalesce("_checked_at", "last_crawl_at"),
        "next_crawl_at": F.when(ran, next_crawl("source_type", "crawl_interval_minutes", "_checked_at")).otherwise(F.col("next_crawl_at")),
    }
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in sources.columns])


def failure_streaks(runs: DataFrame, key: str = "source_id", at: str = "started_at", failed: str = "failed", tie: str = "run_id") -> DataFrame:
    """``runs`` with ``streak``: failures in a row up to and including each run, 0 at a success."""
    order = Window.partitionBy(key).orderBy(at, tie)
    island = F.count_if(~F.col(failed)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(key, "_island").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("_island", island).withColumn("streak", F.count_if(failed).over(within)).drop("_island")

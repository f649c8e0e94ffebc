"""The whole way of a batch: raw rows to candidates, relevance, resolution, jobs and links."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import geo, text
from tidewell.operators import freshness, resolve
from tidewell.sources import normalize, raw
from tidewell.streaming import stream
from tidewell.tables import written

CONTENT = ("title", "company_name", "location", "requisition_id", "canonical_url", "description", "relevance")
JOBS = (
    "job_id long, title string, company_name string, location string, requisition_id string, canonical_url string, description string, relevance string, "
    "canonical_source_id string, canonical_source_type string, first_seen_at timestamp, last_seen_at timestamp, status string"
)
LINKS = (
    "job_id long, source_id string, source_job_id string, source_url string, raw_job_id string, first_seen_at timestamp, last_seen_at timestamp, "
    "missing_count int, active boolean"
)


def classified(candidates: DataFrame, strict_country: bool = False) -> DataFrame:
    """Candidates with id, place and relevance; the first location decides the place."""
    rows = candidates.withColumn("place", geo.split_place("locations_raw"))
    source = F.concat_ws("/", "source_type", "source_external_key")
    return rows.select(
        F.xxhash64(source, "source_job_id").alias("candidate_id"), source.alias("source_id"), "source_type", "source_job_id", F.col("title_original").alias("title"),
        "company_name", F.coalesce(text.job_location("place.city", "place.state", "place.country"), F.lit("")).alias("location"),
        F.lit(None).cast("string").alias("requisition_id"), F.col("apply_url").alias("canonical_url"), F.col("description_text").alias("description"), "fetched_at",
        geo.classify_relevance("locations_raw", "title_original", "description_text", "place.country", strict_country).alias("relevance"),
    )


def publish(candidates: DataFrame, jobs: DataFrame, links: DataFrame, strict_country: bool = False) -> dict[str, DataFrame]:
    """New ``jobs`` and ``links``, the ``rejected`` rows and ``outcomes`` (candidate_id, job_id, how; null how: a new job).

    Rows are resolved against the snapshot first, in fixed precedence; those left over are grouped among themselves. A new job's
    id is a hash of its group, so a batch that runs twice creates nothing twice.
    """
    rows = written(resolve.with_identity(classified(candidates, strict_country)), "candidates")
    kept, rejected = resolve.reject_not_relevant(rows)
    known = resolve.with_identity(jobs).withColumns({"source_id": F.lit(None).cast("string"), "source_job_id": F.lit(None).cast("string")})
    first = links.groupBy("source_id", "source_job_id").agg(F.min("job_id").alias("job_id"))
    found = written(resolve.resolve_identity(kept, known, first), "resolved")
    fresh = kept.join(found.where("job_id is null").select("candidate_id"), "candidate_id", "left_semi")
    groups = resolve.clusters(fresh).withColumn("new_id", F.xxhash64(F.lit("job"), "cluster")).select("candidate_id", "new_id")
    outcomes = written(
        found.join(groups, "candidate_id", "left").select("candidate_id", F.coalesce("job_id", "new_id").alias("job_id"), "how"), "outcomes"
    )
    placed = kept.join(outcomes.select("candidate_id", "job_id"), "candidate_id").withColumn("seen_at", F.col("fetched_at"))
    changes = resolve.collapse(placed, "job_id", "candidate_id").select("job_id", "source_id", "source_type", "seen_at", *CONTENT)
    seen = placed.select("job_id", "source_id", "source_job_id", F.col("canonical_url").alias("source_url"), F.col("candidate_id").cast("string").alias("raw_job_id"), "seen_at")
    return {"jobs": resolve.upsert_job(jobs, changes, CONTENT), "links": resolve.attach_source(links, seen), "rejected": rejected, "outcomes": outcomes}


def publish_latest_raw(history: DataFrame, sources: DataFrame, jobs: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The newest raw row of every posting, normalised and published; ``tallies`` counts created, updated and rejected. Nothing expires."""
    good, errors = normalize.normalize_with_quarantine(raw.latest_raw(history), sources)
    out = publish(good, jobs, links)
    named = out["outcomes"].select(F.when(F.col("how").isNull(), "created").otherwise("updated").alias("outcome"))
    away = out["rejected"].select(F.lit("rejected").alias("outcome"))
    return out | {"errors": errors, "tallies": named.unionByName(away).groupBy("outcome").agg(F.count("*").alias("n"))}


def crawl(envelopes: DataFrame, history: DataFrame, sources: DataFrame, jobs: DataFrame, links: DataFrame, checked_at) -> dict[str, DataFrame]:
    """One crawl of all sources in ``envelopes``: raw rows to append, published jobs and links, freshness and counters."""
    hashed = written(raw.with_payload_hash(envelopes), "crawl")
    append = raw.append_raw_if_new(hashed, history)
    out = publish_latest_raw(hashed, sources, jobs, links)
    key = F.concat_ws("/", "source_type", "source_external_key")
    seen = hashed.select(key.alias("source_id"), "source_job_id")
    new_jobs, new_links = freshness.finalize_source_freshness(written(out["jobs"], "jobs"), written(out["links"], "links"), seen, seen.select("source_id").distinct(), checked_at)
    is_new = append.select("source_id", "source_job_id", "payload_hash", F.lit(True).alias("is_new"))
    failed = out["errors"].select(key.alias("k"), "source_job_id", F.col("processing_error").alias("e1"))
    away = out["rejected"].select(F.col("source_id").alias("k"), "source_job_id", F.col("processing_error").alias("e2"))
    rows = hashed.withColumn("k", key).join(is_new, ["source_id", "source_job_id", "payload_hash"], "left").join(failed, ["k", "source_job_id"], "left").join(away, ["k", "source_job_id"], "left")
    counters = freshness.crawl_outcome(rows.select(F.col("k").alias("source_id"), F.coalesce("is_new", F.lit(False)).alias("is_new"), F.coalesce("e1", "e2").alias("error")))
    return {"append": append, "jobs": new_jobs, "links": new_links, "counters": counters, "errors": out["errors"], "rejected": out["rejected"]}


def publish_stream(candidates: DataFrame, load, save, checkpoint: str):
    """Micro-batches of candidates through ``publish``: ``load()`` gives (jobs, links), ``save(jobs, links, batch_id)`` keeps them.

    ``save`` must replace what it wrote for the same batch id before; the operators are idempotent, so a retried batch is harmless.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        out = publish(batch, *load())
        save(written(out["jobs"], "jobs"), written(out["links"], "links"), batch_id)

    return stream.incremental(candidates, partial(step), checkpoint)

"""Structuring and enrichment of jobs from responses that lie in a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.facts import (
    LISTS, coerce_facts, dropped_skills, ground_employment, ground_experience, ground_mode, ground_skills, leftover_text, lines, parse_salary, scrub, short,
)
from tidewell.functions.geo import fill_state
from tidewell.functions.text import _col, blank_to_null, cache_key, html_to_text, iso_z, normalized_input_text, plain_items, plain_text, structure_hash

TASK_STRUCTURE, TASK_ENRICH = "job_structure", "job_enrichment"


def posting_text(description: Column | str, html: Column | str) -> Column:
    return F.coalesce(plain_text(description), html_to_text(html), F.lit(""))


def cached_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with ``response`` (null: not answered yet), joined on the cache key."""
    return requests.join(responses.select("cache_key", "response"), "cache_key", "left")


def structure_status(jobs: DataFrame) -> Column:
    """skip (ready, same text), failed (no http url, or an answer that is no object), pending (no answer), ready."""
    same = F.coalesce((F.col("structure_status") == "ready") & (F.col("structure_hash") == F.col("digest")), F.lit(False))
    return (
        F.when(same, "skip")
        .when(~F.coalesce(F.col("canonical_apply_url").rlike("^https?://"), F.lit(False)), "failed")
        .when(F.col("response").isNull(), "pending")
        .when(F.col("facts").isNull(), "failed")
        .otherwise("ready")
    )


def sendable(extra: dict[str, Column] | None = None) -> Column:
    """The object for a target: fixed keys are always there, optional ones are null where they are absent."""
    c = F.col
    keys = {
        "external_key": c("exact_fingerprint"), "company_external_key": c("company_normalized"), "company_name": c("company_name"), "title": c("title_original"),
        "summary": c("summary"), "description_text": c("leftover"), "role_category": c("role_category"), "skills": c("skills"),
        "country_code": F.lit("IN"), "experience_min_years": c("experience_min_years"), "experience_label": c("experience_label"),
        "apply_url": c("canonical_apply_url"), "responsibilities": c("responsibilities"), "requirements": c("requirements"),
        "nice_to_have": c("nice_to_have"), "benefits": c("benefits"), "city": blank_to_null("city"), "state": blank_to_null("state"),
        "work_mode": c("work_mode"), "employment_type": c("employment_type"), "posted_at": iso_z("posted_at"), "salary_min": c("salary.salary_min"),
        "salary_max": c("salary.salary_max"), "salary_currency": c("salary.salary_currency"), "salary_period": c("salary.salary_period"),
    }
    return F.struct(*[v.alias(k) for k, v in (keys | (extra or {})).items()])


def structure_postings(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """``jobs`` with ``outcome``, ``digest``, grounded facts and ``payload`` (null unless ready).

    The whole chain of a posting: its text and digest, the answer, typed facts, grounding in the posting, salary, employment,
    mode and state by rule, leftover prose, and the object to send, without markup in any of its fields. The work of a posting
    is large beside its bytes, so postings are dealt over all tasks by ``job_id`` first, however few files they come from.
    """
    rows = jobs.repartition("job_id").withColumn("posting", posting_text("description_text", "description_html"))
    rows = rows.withColumn("digest", structure_hash("title_original", "posting", "city", "canonical_apply_url"))
    rows = cached_response(rows.withColumn("cache_key", cache_key(TASK_STRUCTURE, fixed.STRUCTURE_VERSION, "digest")), responses)
    rows = rows.withColumn("facts", coerce_facts("response"))
    rows = rows.withColumns({"outcome": structure_status(rows), **{f"_{n}": plain_items(f"facts.{n}") for n in LISTS}})
    years = ground_experience("facts.experience_min_years", "facts.experience_label", "posting")
    rows = rows.withColumns(
        {
            "state": fill_state("city", "state"),
            "work_mode": ground_mode("facts.work_mode", "work_mode", "posting", "city", "india_relevance"),
            "employment_type": ground_employment("facts.employment_type", "employment_type", "posting"),
            "salary": parse_salary("posting"),
            "experience": years,
            "dropped": dropped_skills("_skills", "posting", plain=True),
            "summary": short(plain_text("facts.summary"), 2000),
            "role_category": short(plain_text("facts.role_category"), 120),
            "skills": ground_skills("_skills", "posting", plain=True),
            **{n: lines(f"_{n}", plain=True) for n in LISTS if n != "skills"},
        }
    )
    rows = rows.withColumns(
        {
            "experience_min_years": F.col("experience.experience_min_years"), "experience_label": F.col("experience.experience_label"),
            "leftover": leftover_text(plain_text("facts.description_text"), "skills", *[n for n in LISTS if n != "skills"]),
        }
    )
    rows = rows.withColumn("payload", sendable()).drop(*[f"_{n}" for n in LISTS])
    return rows.withColumn("payload", F.when(F.col("outcome") == "ready", scrub(F.col("payload"), rows.schema["payload"].dataType)))


def apply_structured(jobs: DataFrame, structured: DataFrame) -> DataFrame:
    """Facts written back to the jobs that are ready; without a salary its four columns are null."""
    ready = structured.where("outcome = 'ready'")
    cols = {
        "state": F.col("state"), "work_mode": F.col("work_mode"), "employment_type": F.col("employment_type"), "skills": F.col("skills"),
        "salary_min": F.col("salary.salary_min"), "salary_max": F.col("salary.salary_max"), "salary_currency": F.col("salary.salary_currency"),
        "salary_period": F.col("salary.salary_period"), "structure_status": F.lit("ready"), "structure_hash": F.col("digest"),
    }
    new = ready.select("job_id", *[v.alias(f"_{k}") for k, v in cols.items()]).withColumn("_ready", F.lit(True))
    both = jobs.join(new, "job_id", "left")
    return both.select(*[F.when(F.col("_ready"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in jobs.columns])


def pipeline_trace(structured: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """(job_id, step_no, step, at, detail): an append-only table of the steps of each job; read it ordered by (job_id, step_no)."""
    base = structured.where("outcome <> 'skip'")
    step = lambda n, name, at, detail: base.select("job_id", F.lit(n).alias("step_no"), F.lit(name).alias("step"), iso_z(at).alias("at"), detail.alias("detail"))
    frames = [
        step(1, "fetched", "fetched_at", F.to_json(F.struct("source_type", "source_job_id"))),
        step(2, "normalized", "checked_at", F.to_json(F.struct(F.col("title_original").alias("title"), "company_name", "city", "state"))),
        step(3, "model", "checked_at", F.col("response")),
        step(4, "checked", "checked_at", F.to_json(F.struct("dropped"))),
        step(5, "saved", "checked_at", F.col("outcome")),
    ]
    if sent is not None:
        frames.append(sent.select("job_id", F.lit(6).alias("step_no"), F.lit("sent").alias("step"), iso_z("synced_at").alias("at"), F.to_json(F.struct("target", "action")).alias("detail")))
    return reduce(DataFrame.unionByName, frames)


ENRICHMENT_KEYS = ("normalized_title", "role_category", "seniority", "skills", "experience_min", "experience_max", "work_mode", "india_eligibility")


def validate_enrichment(response: Column | str) -> Column:
    """The response as a typed struct, or null: all keys and no others, at most 20 non-blank skills, known values, an ordered range."""
    v = F.try_parse_json(_col(response))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    number = lambda k: F.when(kind(k).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{k}", "double"))
    skills = F.transform(F.try_variant_get(v, "$.skills", "array<variant>"), lambda s: F.when(F.schema_of_variant(s) == "STRING", F.trim(F.try_variant_get(s, "$", "string"))))
    nullable = lambda k, c: c.isNotNull() | (kind(k) == "VOID")
    texts = [nullable(k, text(k)) for k in ("normalized_title", "role_category", "seniority")]
    numbers = [nullable(k, number(k)) for k in ("experience_min", "experience_max")]
    good = reduce(
        lambda a, b: a & b,
        [
            F.size(keys) == len(ENRICHMENT_KEYS), F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ENRICHMENT_KEYS]))) == 0, *texts, *numbers,
            F.size(skills) <= 20, F.forall(skills, lambda s: F.coalesce(s != "", F.lit(False))),
            (kind("work_mode") == "VOID") | F.coalesce(text("work_mode").isin("onsite", "hybrid", "remote", "unknown"), F.lit(False)),
            F.coalesce(text("india_eligibility").isin("india", "remote_india", "not_india", "unknown"), F.lit(False)),
            F.coalesce(number("experience_min") <= number("experience_max"), F.lit(True)),
        ],
    )
    made = F.struct(
        *[text(k).alias(k) for k in ("normalized_title", "role_category", "seniority")], skills.alias("skills"),
        *[number(k).alias(k) for k in ("experience_min", "experience_max")], text("work_mode").alias("work_mode"), text("india_eligibility").alias("india_eligibility"),
    )
    return F.when(F.coalesce(good, F.lit(False)), made)


def needs_enrichment(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("india_relevance").isin("unknown", "unknown_remote") & ~F.col("ai_enriched"))


def apply_enrichment(jobs: DataFrame, enrichments: DataFrame) -> DataFrame:
    """``enrichments``: (job_id, e). Non-null facts overwrite; relevance only where it was unknown and the answer is known."""
    both = jobs.join(enrichments.where("e is not null").select("job_id", "e"), "job_id", "left")
    open_ = F.col("india_relevance").isin("unknown", "unknown_remote") & (F.col("e.india_eligibility") != "unknown")
    made = {
        "title_normalized": F.coalesce(blank_to_null("e.normalized_title"), F.col("title_normalized")),
        "skills": F.when(F.size("e.skills") > 0, F.col("e.skills")).otherwise(F.col("skills")),
        "experience_min": F.coalesce(F.col("e.experience_min"), F.col("experience_min")), "experience_max": F.coalesce(F.col("e.experience_max"), F.col("experience_max")),
        "work_mode": F.coalesce(F.col("e.work_mode"), F.col("work_mode")),
        "india_relevance": F.when(F.coalesce(open_, F.lit(False)), F.col("e.india_eligibility")).otherwise(F.col("india_relevance")),
        "ai_enriched": F.col("ai_enriched") | F.col("e").isNotNull(),
    }
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in jobs.columns])


def admit_under_budget(requests: DataFrame, budget: int, spent: DataFrame | None = None, tries: int = 1) -> DataFrame:
    """Requests with ``admitted``: hits are free; of the misses of a day, in order of arrival, as many as the budget allows.

    ``spent``: (day, request_count) already used. The window holds one day's misses, so its size is bounded by a day's requests.
    """
    order = Window.partitionBy("day", "hit").orderBy("arrival", "cache_key")
    rows = requests.withColumn("_n", F.row_number().over(order))
    if spent is not None:
        rows = rows.join(spent.select("day", F.col("request_count").alias("_spent")), "day", "left")
    else:
        rows = rows.withColumn("_spent", F.lit(0))
    return rows.withColumn("admitted", F.col("hit") | (F.col("_n") * tries + F.coalesce("_spent", F.lit(0)) <= budget)).drop("_n", "_spent")


def enrich_jobs(jobs: DataFrame, responses: DataFrame, budget: int, version: str = "v1", spent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs, requests): unknown postings enriched from stored answers; requests are the admitted ones without an answer."""
    text = normalized_input_text("title_original", F.concat_ws(", ", "city", "state"), "description_text")
    asked = needs_enrichment(jobs).withColumn("cache_key", cache_key(TASK_ENRICH, version, text))
    found = cached_response(asked.select("job_id", "cache_key", F.to_date("last_checked_at").alias("day"), F.col("last_checked_at").alias("arrival")), responses)
    valid = found.select("job_id", validate_enrichment("response").alias("e"))
    open_ = found.where("response is null").groupBy("cache_key").agg(F.min("day").alias("day"), F.min("arrival").alias("arrival")).withColumn("hit", F.lit(False))
    return apply_enrichment(jobs, valid), admit_under_budget(open_, budget, spent).where("admitted")

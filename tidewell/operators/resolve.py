"""Entity resolution: postings against a snapshot of jobs, by exact keys and by blocked similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import exact_fingerprint, fuzzy_title, normalize_company, normalize_location, normalize_url, requisition_key, token_fingerprint
from tidewell.tables import written

from .clusters import connected_components
from .similar import class_key, classes, near_classes, near_links


def source_rank(source_type: Column | str) -> Column:
    """Lower is better: employer board, other feed, aggregator, generic copy."""
    c = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(c.isin(*fixed.EMPLOYER_SOURCES), 0).when(c.isin(*fixed.AGGREGATORS), 2).when(c == "generic", 3).otherwise(1)


def with_identity(df: DataFrame, company="company_name", title="title", location="location", requisition="requisition_id", url="canonical_url", description="description") -> DataFrame:
    """``df`` with the keys that matching needs, each computed once."""
    return df.withColumns(
        {
            "company_key": normalize_company(company),
            "title_key": fuzzy_title(title),
            "location_key": normalize_location(location),
            "fingerprint": exact_fingerprint(company, title, location, requisition),
            "url_key": normalize_url(url),
            "requisition_key": requisition_key(company, requisition),
            "text_key": token_fingerprint(description),
        }
    )


def match_on(candidates: DataFrame, jobs: DataFrame, key: str, job_id: str = "job_id", candidate_id: str = "candidate_id") -> DataFrame:
    """(candidate_id, job_id) where both have the same non-null key: one equi-join, nulls never meet.

    A key that very many rows share is first reduced to its least job: it is the one that is taken.
    """
    right = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(job_id).alias(job_id))
    return candidates.where(F.col(key).isNotNull()).select(candidate_id, key).join(right, key).select(candidate_id, job_id)


def match_by_link(candidates: DataFrame, links: DataFrame) -> DataFrame:
    return candidates.join(links.select("source_id", "source_job_id", "job_id"), ["source_id", "source_job_id"]).select("candidate_id", "job_id")


def match_by_fingerprint(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    return match_on(candidates, jobs, "fingerprint")


def match_by_url(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    return match_on(candidates, jobs, "url_key")


def fuzzy_pairs(candidates: DataFrame, jobs: DataFrame, title_threshold: float = fixed.TITLE_THRESHOLD, text_threshold: float = fixed.DESCRIPTION_THRESHOLD) -> DataFrame:
    """(candidate_id, job_id) of the same company and place, near titles and near descriptions: all pairs, written out.

    Where the least job is enough, or which postings hang together, ``fuzzy_matches`` and ``clusters`` do without.
    """
    a, b = (rows.select(i, class_key().alias(k)) for rows, i, k in ((candidates, "candidate_id", "a_class"), (jobs, "job_id", "b_class")))
    near = near_classes(classes(candidates, "candidate_id"), classes(jobs, "job_id"), title_threshold, text_threshold)
    return a.join(near.select("a_class", "b_class"), "a_class").join(b, "b_class").select("candidate_id", "job_id")


def fuzzy_matches(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(candidate_id, job_id): the least job that is like each candidate; postings that match alike are compared once."""
    if jobs.isEmpty():
        return candidates.select("candidate_id", F.lit(None).cast(jobs.schema["job_id"].dataType).alias("job_id")).limit(0)
    candidates = candidates.join(jobs.select("company_key").distinct(), "company_key", "left_semi")
    best = near_classes(classes(candidates, "candidate_id"), classes(jobs, "job_id")).groupBy("a_class").agg(F.min("b_least").alias("job_id"))
    return candidates.select("candidate_id", class_key().alias("a_class")).join(best, "a_class").select("candidate_id", "job_id")


def find_exact(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(candidate_id, job_id): the first job that shares an exact key.

    The four exact keys are four equi-joins in a union, never one join on a disjunction.
    """
    posting = F.when(F.col("source_id").isNotNull() & F.col("source_job_id").isNotNull(), F.concat_ws("\x1f", "source_id", "source_job_id"))
    c, j = candidates.withColumn("posting_key", posting), jobs.withColumn("posting_key", posting)
    exact = reduce(DataFrame.unionByName, [match_on(c, j, k) for k in ("fingerprint", "posting_key", "url_key", "requisition_key")])
    return exact.groupBy("candidate_id").agg(F.min("job_id").alias("job_id"))


def find_duplicates(candidates: DataFrame, jobs: DataFrame, order: str = "job_id") -> DataFrame:
    """(candidate_id, job_id, how): the first job in list order that shares an exact key, else the first similar one."""
    exact = find_exact(candidates, jobs).withColumn("how", F.lit("exact"))
    rest = candidates.join(exact.select("candidate_id"), "candidate_id", "left_anti")
    fuzzy = fuzzy_matches(rest, jobs).withColumn("how", F.lit("fuzzy"))
    return exact.unionByName(fuzzy)


def resolve_identity(candidates: DataFrame, jobs: DataFrame, links: DataFrame) -> DataFrame:
    """``candidate_id, job_id, how``: link, fingerprint, url, then duplicate search; null job where none is found."""
    tagged = [
        match_by_link(candidates, links).withColumn("p", F.lit(1)),
        match_by_fingerprint(candidates, jobs).withColumn("p", F.lit(2)),
        match_by_url(candidates, jobs).withColumn("p", F.lit(3)),
    ]
    hits = reduce(DataFrame.unionByName, tagged).groupBy("candidate_id").agg(F.min(F.struct("p", "job_id")).alias("best"))
    rest = candidates.join(hits.select("candidate_id"), "candidate_id", "left_anti")
    dup = find_duplicates(rest, jobs)
    names = F.element_at(F.array(F.lit("link"), F.lit("fingerprint"), F.lit("url")), F.col("best.p"))
    found = hits.select("candidate_id", F.col("best.job_id").alias("job_id"), names.alias("how")).unionByName(dup)
    return candidates.select("candidate_id").join(found, "candidate_id", "left")


def collapse(rows: DataFrame, group: str, arrival: str) -> DataFrame:
    """One row of each group of duplicates: that of the best source, the earliest on a tie."""
    best = Window.partitionBy(group).orderBy(source_rank("source_type"), F.col(arrival))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def should_replace(canonical_source: Column, canonical_type: Column, source: Column, source_type: Column) -> Column:
    return canonical_source.isNull() | (canonical_source == source) | (source_rank(source_type) < source_rank(canonical_type))


def clusters(rows: DataFrame, keys: tuple[str, ...] = ("fingerprint", "url_key", "requisition_key"), fuzzy: bool = True) -> DataFrame:
    """(candidate_id, cluster): transitive groups among new rows; ids must be long. Rows without a partner are their own group.

    Rows are grouped by keys first; texts are compared only between groups that are not one already.
    """
    edges = []
    for k in keys:
        own = rows.where(F.col(k).isNotNull()).select("candidate_id", k)
        first = own.groupBy(k).agg(F.min("candidate_id").alias("v"))  # a key's rows form a star, not all pairs
        edges.append(own.join(first, k).select(F.col("candidate_id").alias("u"), "v"))
    if fuzzy:
        alike = written(classes(rows, "candidate_id"), "classes")
        own = rows.select("candidate_id", class_key().alias("class_key")).join(alike.select("class_key", "least"), "class_key")
        edges.append(own.select(F.col("candidate_id").alias("u"), F.col("least").alias("v")))
    found = connected_components(reduce(DataFrame.unionByName, edges))
    named = rows.select("candidate_id").join(found.withColumnRenamed("node", "candidate_id"), "candidate_id", "left").select(
        "candidate_id", F.coalesce("component", "candidate_id").alias("cluster")
    )
    if not fuzzy:
        return named
    named = written(named, "by-keys")
    grouped = written(alike.join(named.select(F.col("candidate_id").alias("least"), F.col("cluster").alias("group")), "least"), "grouped")
    joined = connected_components(near_links(grouped)).withColumnRenamed("node", "cluster")
    return named.join(joined, "cluster", "left").select("candidate_id", F.coalesce("component", "cluster").alias("cluster"))


def upsert_job(jobs: DataFrame, changes: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """New snapshot of jobs. ``changes``: job_id, source_id, source_type, seen_at and the content columns, one row a job.

    An unknown job is created; a known one gets new content where its canonical source is null, the same, or of a worse
    rank, and is seen and active again in any case.
    """
    c = changes.select("job_id", *[F.col(x).alias(f"_{x}") for x in ("source_id", "source_type", "seen_at", *content)]).withColumn("_change", F.lit(True))
    both = jobs.join(c, "job_id", "full_outer")
    created = F.col("first_seen_at").isNull()
    put = F.coalesce(F.col("_change"), F.lit(False)) & (
        created | should_replace(F.col("canonical_source_id"), F.col("canonical_source_type"), F.col("_source_id"), F.col("_source_type"))
    )
    change = F.coalesce(F.col("_change"), F.lit(False))
    pick = lambda cond, new, old: F.when(cond, F.col(new)).otherwise(F.col(old)).alias(old)
    made = {x: pick(put, f"_{x}", x) for x in content}
    made |= {
        "canonical_source_id": pick(put, "_source_id", "canonical_source_id"), "canonical_source_type": pick(put, "_source_type", "canonical_source_type"),
        "first_seen_at": F.coalesce("first_seen_at", "_seen_at").alias("first_seen_at"), "last_seen_at": pick(change, "_seen_at", "last_seen_at"),
        "status": F.when(change, "active").otherwise(F.col("status")).alias("status"),
    }
    return both.select(*[made.get(x, F.col(x)) for x in jobs.columns])


def attach_source(links: DataFrame, seen: DataFrame) -> DataFrame:
    """New snapshot of links: each seen (job, source, source job) is inserted or refreshed, active and not missing."""
    key = ["job_id", "source_id", "source_job_id"]
    s = seen.select(*key, *[F.col(c).alias(f"_{c}") for c in ("source_url", "raw_job_id", "seen_at")]).withColumn("_seen", F.lit(True)).dropDuplicates(key)
    both = links.join(s, key, "full_outer")
    on = F.coalesce(F.col("_seen"), F.lit(False))
    made = {
        "source_url": F.when(on, F.col("_source_url")).otherwise(F.col("source_url")), "raw_job_id": F.when(on, F.col("_raw_job_id")).otherwise(F.col("raw_job_id")),
        "first_seen_at": F.coalesce("first_seen_at", "_seen_at"), "last_seen_at": F.when(on, F.col("_seen_at")).otherwise(F.col("last_seen_at")),
        "missing_count": F.when(on, 0).otherwise(F.col("missing_count")), "active": F.when(on, True).otherwise(F.col("active")),
    }
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in links.columns])


def reject_not_relevant(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows classified as elsewhere get a status instead of a job."""
    away = F.coalesce(F.col("relevance") == "not_india", F.lit(False))
    return rows.where(~away), rows.where(away).withColumns({"processing_status": F.lit("rejected"), "processing_error": F.lit("not_india")})

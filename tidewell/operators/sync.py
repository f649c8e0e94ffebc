"""Change-sets for a target: what to post, what to reconcile, what to forget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.text import job_location
from tidewell.tables import written

from .serve import published


def can_send() -> Column:
    """Structured, complete, keyed as the job is, within length limits, and an http(s) link."""
    get = lambda k: F.trim(F.coalesce(F.col(f"payload.{k}"), F.lit("")))
    company = F.coalesce(F.nullif(get("company_external_key"), F.lit("")), get("company_name"))
    key, url = get("external_key"), get("apply_url")
    good = (
        (F.col("structure_status") == "ready") & F.col("payload").isNotNull() & (get("title") != "") & (company != "") & (key != "")
        & (key == F.col("exact_fingerprint")) & (F.length(key) <= 255) & (F.length(url) <= 500) & url.rlike("^https?://")
    )
    return F.coalesce(good, F.lit(False))


def _order() -> list:
    return [F.col("company_normalized"), F.desc_nulls_last("posted_at"), F.col("id")]


def postable(jobs: DataFrame) -> DataFrame:
    return published(jobs).where(can_send())


def postable_ordered(jobs: DataFrame) -> DataFrame:
    return postable(jobs).orderBy(*_order())


def active_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("exact_fingerprint").alias("external_key")).distinct()


def unsynced(rows: DataFrame, acks: DataFrame, target: str) -> DataFrame:
    done = acks.where(F.col("target") == target).select(F.col("external_key").alias("exact_fingerprint"))
    return rows.join(done, "exact_fingerprint", "left_anti")


def waiting_count(rows: DataFrame, acks: DataFrame, target: str) -> DataFrame:
    return unsynced(rows, acks, target).agg(F.count("*").alias("waiting"))


def first_per_fingerprint(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("exact_fingerprint").orderBy(*_order())
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def company_payloads(rows: DataFrame, publish: bool) -> DataFrame:
    """(external_key, name, primary_location, publish): the name most used (ties A to Z), the first location in posting order."""
    named = rows.groupBy("company_normalized", F.trim("company_name").alias("name")).agg(F.count("*").alias("n"))
    name = named.groupBy("company_normalized").agg(F.min(F.struct((-F.col("n")).alias("o"), F.lower("name").alias("l"), "name"))["name"].alias("name"))
    place = job_location("city", "state", "country_code", 180)
    order = F.struct(F.col("posted_at").isNull(), (-F.unix_micros(F.col("posted_at").cast("timestamp"))).alias("p"), "id")
    first = rows.withColumn("_place", place).where("_place is not null").groupBy("company_normalized").agg(F.min_by("_place", order).alias("primary_location"))
    out = name.join(first, "company_normalized", "left")
    return out.select(F.col("company_normalized").alias("external_key"), "name", "primary_location", F.lit(publish).alias("publish"))


def batches(rows: DataFrame, size: int = fixed.BATCH_ROWS) -> DataFrame:
    """``rows`` with ``batch_no`` (from 1) and ``pos`` in posting order.

    Rows are numbered inside ranges of the order and shifted by the rows of the ranges before, so that no task sees all rows.
    The ranges are written first: drawn anew, their bounds could differ between the two uses.
    """
    ranged = written(rows.repartitionByRange(*_order()).withColumn("_range", F.spark_partition_id()), "batch-ranges")
    within = Window.partitionBy("_range").orderBy(*_order())
    numbered = ranged.withColumn("_n", F.row_number().over(within))
    counts = numbered.groupBy("_range").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    n = F.col("_base") + F.col("_n")
    out = numbered.join(bases, "_range").withColumns({"batch_no": F.ceil(n / size).cast("int"), "pos": F.pmod(n - 1, F.lit(size)).cast("int")})
    return out.drop("_range", "_n", "_base")


def ack_results(sent: DataFrame, results: DataFrame, target: str) -> DataFrame:
    """(target, external_key, action): sent rows beside results by batch and position; created and updated are accepted."""
    both = sent.select("batch_no", "pos", F.col("exact_fingerprint").alias("external_key")).join(results, ["batch_no", "pos"])
    return both.where(F.col("action").isin("created", "updated")).select(F.lit(target).alias("target"), "external_key", "action")


def action_tallies(results: DataFrame) -> DataFrame:
    """(name, n): created, updated, skipped (other actions too), and each reason of a skip."""
    action = F.when(F.col("action").isin("created", "updated"), F.col("action")).otherwise("skipped")
    reason = F.when((F.col("action") == "skipped") & (F.col("reason") != ""), F.col("reason"))
    names = results.select(F.explode(F.filter(F.array(action, reason), lambda x: x.isNotNull())).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


def reconcile_set(keys: DataFrame) -> DataFrame:
    return keys.select("external_key").distinct()


def deactivate_set(keys: DataFrame, acks: DataFrame, target: str) -> DataFrame:
    """All acknowledged keys of the target, but only if nothing is active."""
    some = keys.limit(1).agg(F.count("*").alias("_n"))
    mine = acks.where(F.col("target") == target).select("external_key", F.lit(0).alias("_n"))
    return mine.join(some, "_n").select("external_key")


def forget_stale(acks: DataFrame, keys: DataFrame, target: str) -> DataFrame:
    """Acknowledgements that stay: all of other targets, and those of this one that are still active."""
    mine = acks.where(F.col("target") == target).join(keys.select("external_key").distinct(), "external_key", "left_semi").select(acks.columns)
    return acks.where(~F.coalesce(F.col("target") == target, F.lit(False))).unionByName(mine)


def remember(acks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old and new acknowledgements; one that is there already is not added again."""
    key = ["target", "external_key"]
    new = fresh.dropDuplicates(key).join(acks.select(*key), key, "left_anti")
    return acks.unionByName(new.select(acks.columns))


def transfer_plan(jobs: DataFrame, acks: DataFrame, target: str, publish: bool = False) -> dict[str, DataFrame]:
    """Named frames of one transfer; where there is nothing to do they are all empty."""
    rows = postable(jobs)
    keys, waiting = active_keys(rows), unsynced(rows, acks, target)
    return {
        "companies": company_payloads(waiting, publish),
        "jobs": batches(first_per_fingerprint(waiting)),
        "reconcile": reconcile_set(keys),
        "deactivate": deactivate_set(keys, acks, target),
        "acks": forget_stale(acks, keys, target),
    }

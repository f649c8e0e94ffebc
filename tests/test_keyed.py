"""Bucketed tables and database tables."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators import resolve
from tidewell.sources import keyed, raw

SNAPSHOT = "job_id long, title string, canonical_source_id long, canonical_source_type string, first_seen_at timestamp, last_seen_at timestamp, status string"
CHANGES = "job_id long, title string, source_id long, source_type string, seen_at timestamp"


def merge(old, new):
    return resolve.upsert_job(old, new, ("title",))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    at = F.lit("2024-01-01").cast("timestamp")
    rows = spark.range(400).select(F.col("id").alias("job_id"), F.lit("old").alias("title"), F.lit(1).cast("long").alias("canonical_source_id"), F.lit("adzuna").alias("canonical_source_type"), at.alias("first_seen_at"), at.alias("last_seen_at"), F.lit("expired").alias("status"))
    keyed.create_keyed(rows, name, str(tmp_path / name), ("job_id",), buckets=16)
    yield spark, name, str(tmp_path / name), rows
    spark.sql(f"DROP TABLE {name}")


def changes(spark, ids):
    return spark.createDataFrame([(i, f"new{i}", 2, "lever", None) for i in ids], CHANGES).withColumn("seen_at", F.lit("2024-02-01").cast("timestamp"))


def test_an_upsert_rewrites_the_touched_buckets_alone(stored):
    spark, name, path, rows = stored
    before = files(path)
    assert len(before) == 16
    batch = changes(spark, [3, 4, 1000])
    hit = keyed.merge_keyed(spark, name, batch, merge)
    assert 0 < len(hit) <= 3
    after = files(path)
    kept = {f for f in before if not any(f"{keyed.BUCKET}={b}/" in f for b in hit)}
    assert kept and {f: before[f] for f in kept} == {f: after.get(f) for f in kept} and len(after) == 16 and len(set(after) - set(before)) == len(hit)
    want = sorted(map(tuple, merge(rows, batch).collect()))
    assert sorted(map(tuple, spark.table(name).drop(keyed.BUCKET).collect())) == want
    keyed.merge_keyed(spark, name, batch, merge)  # a batch that runs again
    assert sorted(map(tuple, spark.table(name).drop(keyed.BUCKET).collect())) == want
    assert keyed.merge_keyed(spark, name, batch.limit(0), merge) == []


def test_the_stored_side_is_not_moved(stored):
    spark, name, _, _ = stored
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        old = spark.table(name).where(F.col(keyed.BUCKET).isin(1, 2)).drop(keyed.BUCKET)
        for df in (merge(old, changes(spark, [3, 4])), keyed.new_rows(spark, name, changes(spark, [3, 4]).select("job_id"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scans = [part for part in plan.split("FileScan")[1:]]
            assert scans and all("Bucketed: true" in x for x in scans)
            lines = plan.splitlines()
            for i, line in enumerate(lines):
                if "FileScan" in line:  # no exchange between the scan and the join above it
                    above = []
                    for up in reversed(lines[:i]):
                        above.append(up)
                        if "Join" in up:
                            break
                    assert not any("Exchange" in up for up in above), plan
    finally:
        spark.conf.set(key, before)


def test_appended_rows_are_those_of_unknown_keys(stored):
    spark, name, _, rows = stored
    batch = spark.createDataFrame([(3,), (999,), (999,), (None,)], "job_id long")
    assert sorted(str(r[0]) for r in keyed.new_rows(spark, name, batch).collect()) == ["999", "999", "None"]
    more = rows.where("job_id < 5").withColumn("job_id", F.col("job_id") + 5000)
    keyed.append_keyed(spark, name, more)
    assert spark.table(name).count() == 405 and keyed.new_rows(spark, name, more.select("job_id")).count() == 0


def test_database_tables(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tempfile.gettempdir()}/derby.log")
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    raw.run_sql(spark, url, 'CREATE TABLE jobs ("id" BIGINT, "name" VARCHAR(20), "batch_id" BIGINT)')
    assert raw.read_jdbc(spark, url, "jobs", '"id"', 8).count() == 0
    rows = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"))
    raw.write_jdbc(rows, url, "jobs", 1)
    raw.write_jdbc(spark.createDataFrame([(None, "none")], "id long, name string"), url, "jobs", 2)
    raw.write_jdbc(rows.where("id < 60"), url, "jobs", 1)  # the batch again, with fewer rows
    back = raw.read_jdbc(spark, url, "jobs", '"id"', 8)
    assert back.rdd.getNumPartitions() == 8
    assert sorted((x["id"] if x["id"] is not None else -1, x["name"], x["batch_id"]) for x in back.collect()) == [(-1, "none", 2)] + [(i, f"n{i}", 1) for i in range(60)]
    assert raw.read_jdbc(spark, url, "jobs").count() == 61

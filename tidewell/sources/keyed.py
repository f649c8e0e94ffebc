"""Tables that lie by key: a batch meets them without moving them, and only the buckets that it touches are written again.

A table is bucketed by its key and parted by the number of the bucket, so each bucket is a directory of its own. Joins on the key read
the buckets as they lie; only the batch is shuffled. An upsert reads and replaces the touched buckets alone.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
BUCKETS = 64


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    """The number under which Spark files a row of a bucketed table."""
    return F.pmod(F.hash(*[F.col(c) for c in key]), F.lit(buckets))


def create_keyed(df: DataFrame, name: str, path: str, key: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """``df`` as table ``name`` under ``path``, one file a bucket."""
    rows = df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(buckets, *[F.col(c) for c in key])
    rows.write.mode("overwrite").partitionBy(BUCKET).bucketBy(buckets, *key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name).drop(BUCKET)


def _spec(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    shown = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return int(shown["Num Buckets"]), [c.strip(" `") for c in shown["Bucket Columns"].strip("[]").split(",")]


@contextmanager
def _dynamic(spark: SparkSession):
    """Overwriting replaces the parts that are written and no others."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def touched_buckets(batch: DataFrame, key: list[str], buckets: int) -> list[int]:
    """The buckets in which a batch has keys: at most ``buckets`` numbers."""
    return sorted(r[0] for r in batch.select(bucket_of(tuple(key), buckets)).distinct().collect())


def merge_keyed(spark: SparkSession, name: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that ``batch`` touches by ``merge(rows of these buckets, batch)``; the numbers of these buckets.

    ``merge`` joins on the key and returns the table's columns. Both sides of a bucket are in one task, which writes
    its file; a batch that runs again gives the same buckets again, if ``merge`` does.
    """
    buckets, key = _spec(spark, name)
    hit = touched_buckets(batch, key, buckets)
    if hit:
        stored = spark.table(name)
        old = stored.where(F.col(BUCKET).isin(hit)).drop(BUCKET)
        new = merge(old, batch).withColumn(BUCKET, bucket_of(tuple(key), buckets))
        with _dynamic(spark):
            new.select(*stored.columns).write.mode("overwrite").insertInto(name)
    return hit


def new_rows(spark: SparkSession, name: str, batch: DataFrame) -> DataFrame:
    """The rows of ``batch`` whose key the table does not have; of equal keys in the batch all. Null keys are never known.

    The table's keys are met by a semi-join that starts from the batch, so that a Bloom filter of its keys can stand before the scan.
    """
    buckets, key = _spec(spark, name)
    hit = touched_buckets(batch, key, buckets)
    stored = spark.table(name).where(F.col(BUCKET).isin(hit)).select(*key)
    known = stored.join(batch.select(*key).distinct(), key, "left_semi").distinct()
    return batch.join(known, key, "left_anti")


def append_keyed(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Add rows as new files of their buckets."""
    buckets, key = _spec(spark, name)
    filed = rows.withColumn(BUCKET, bucket_of(tuple(key), buckets)).repartition(buckets, *key)
    filed.select(*spark.table(name).columns).write.mode("append").insertInto(name)

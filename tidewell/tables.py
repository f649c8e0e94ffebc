"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder named by ``spark.checkpoint.dir``; Spark deletes it when the application ends.

    A local folder is set only where that is unset and the master is local (tests): on a cluster the executors would each
    write to a disk of their own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    mine = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    _delete(spark, mine, at_exit=True)
    return mine


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        store.mkdirs(where)
        store.deleteOnExit(where)
    else:
        store.delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Have Spark delete a query's shuffle files when it ends: what they held is in the table then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, *used_up: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    The plan that follows starts from files, so a lost executor costs a re-read and not the jobs before,
    and nothing upstream is computed twice. ``used_up`` are tables of this function that nothing reads after this one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    for table_ in used_up:
        _delete(spark, table_.scratch_path)
    return back


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table_ in tables:
        _delete(table_.sparkSession, table_.scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

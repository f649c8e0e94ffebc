"""As-of join by a sorted sweep: each left row with the newest right row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.tables import written


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: tuple[str, ...], ties: tuple[str, ...] = ()) -> DataFrame:
    """``left`` columns and ``asof``, a struct of ``right_at`` and the ``value`` columns; null where no right row is early enough.

    Both sides become events in one order of (key, time); a right row comes before left rows of its time. The events are cut
    into ranges of that order, so a key with very many rows is many tasks. Within a range the last right row runs along; what a range
    begins with is carried over from the ranges before it by a table of one row a key and range. No step has more rows
    than both sides together. Of right rows of equal time the last by ``ties`` counts. Left rows with a null key or time have
    a null ``asof``; repeated left rows stay.
    """
    named = F.struct(F.col(right_at), *[F.col(c) for c in value])
    rest = F.xxhash64(*[F.col(c) for c in left.columns if c != key])  # parts rows of one key and time
    l = left.select(F.col(key).alias("_key"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), rest.alias("_salt"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(named.alias("x")).schema["x"].dataType).alias("_value"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)])
    r = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("_key"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_salt"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), named.alias("_value"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)])
    order = ["_at", "_side", *[f"_tie{i}" for i in range(len(ties))], "_salt"]
    events = l.where(F.col("_key").isNotNull() & F.col("_at").isNotNull()).unionByName(r)
    events = written(events.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()), "asof-events")
    by_time = F.when(F.col("_side") == 0, F.struct(*order))
    last = events.groupBy("_key", "_part").agg(F.max_by("_value", by_time).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seams = last.select("_key", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.join(seams, ["_key", "_part"]).withColumn("asof", F.coalesce(F.last("_value", ignorenulls=True).over(within), "_carried"))
    found = swept.where("_side = 1").select("_row.*", "asof")
    none = left.where(F.col(key).isNull() | F.col(left_at).isNull()).withColumn("asof", F.lit(None).cast(found.schema["asof"].dataType))
    return found.unionByName(none)

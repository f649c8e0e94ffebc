"""Sharding by a two-pass external shuffle.

Pass one scatters every record into a memory-sized bucket by a seeded hash; pass two draws a Fisher-Yates
permutation of each bucket. A shard is a run of buckets, so a shard may be far larger than memory.
The shard itself is chosen by rendezvous hashing of the document id: one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import numbered_among_equals, row_hash, written

SEED = 20240607
BUCKET_BYTES = 8 << 20


def shard_of(key: str, n_shards: int, seed: int = SEED) -> F.Column:
    """The shard whose hash with the key is the largest (an id decides alone; a null id is a key too)."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.struct(F.xxhash64(F.lit(seed), i, F.col(key)).alias("score"), i.alias("shard")),
    )
    return F.array_max(scores)["shard"]


def record_size(text: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """Position of each of n records; ``Generator.permutation`` is Fisher-Yates on an index array."""
    order = np.random.default_rng(seed).permutation(n)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return place


def external_shuffle(
    docs: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    names: tuple[str, str, str] = ("_shard", "_grown_shard", "_slot"),
) -> DataFrame:
    """All rows and columns of ``docs`` with shard, shard among one more, and slot, called by ``names``.

    The slot counts from 0 without gaps inside each shard, in shuffled order. Reruns agree, whatever the
    partitioning: a bucket's records are put in order of (key, row hash) before they are permuted.
    A key with very many rows fills its one shard, not one bucket: buckets are counted by the shard's bytes and chosen by a hash
    of the whole row; where equal rows alone exceed a bucket, by their number among them too.
    Null keys hash as a key of their own; null texts travel as they are; repeated rows keep one slot each;
    a very long text is a record like any other; an empty table gives an empty result. ``names`` that are columns of ``docs``
    already are refused (``free_names`` gives such that are not); no other name clashes.
    """
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    # inside, the columns of docs go by number, so that none of them meets a name of this function
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = T.StructType([T.StructField(at[f.name], f.dataType) for f in docs.schema.fields] + [T.StructField("_shard", T.IntegerType()), T.StructField("_grown_shard", T.IntegerType()), T.StructField("_slot", T.LongType())])
    moved = _moved(inner, n_shards, at[key], at[text], seed, bucket_bytes, out)
    return moved.toDF(*docs.columns, *names)


def _moved(docs: DataFrame, n_shards: int, key: str, text: str, seed: int, bucket_bytes: int, out: T.StructType) -> DataFrame:
    weight = docs.select(shard_of(key, n_shards, seed).alias("s"), record_size(text).alias("b")).groupBy("s").agg(F.sum("b")).collect()  # a row a shard
    weight = {s: -(-b // bucket_bytes) for s, b in weight}
    per_shard = F.array(*[F.lit(max(1, weight.get(s, 1))) for s in range(n_shards)])
    placed = docs.withColumn("_order", row_hash(docs))
    heavy = placed.groupBy("_order").agg(F.sum(record_size(text)).alias("_bytes")).where(F.col("_bytes") > bucket_bytes).select("_order")
    heavy = written(heavy, "shuffle-equal-rows")
    nth = F.lit(0).cast("long")
    if not heavy.isEmpty():
        placed, nth = numbered_among_equals(placed, heavy), F.col("_nth")
    placed = placed.withColumn("_nth", nth).withColumns(
        {
            "_shard": shard_of(key, n_shards, seed),
            "_grown_shard": shard_of(key, n_shards + 1, seed),
        }
    ).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), "_order", "_nth"), F.get(per_shard, F.col("_shard"))))
    sizes = placed.groupBy("_shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    placed = placed.join(bases, ["_shard", "_bucket"])

    def permute(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        bucket = bucket.take(pa.compute.sort_indices(bucket, [(key, "ascending"), ("_order", "ascending")]))
        n, shard, sub = bucket.num_rows, bucket["_shard"][0].as_py(), bucket["_bucket"][0].as_py()
        slots = _fisher_yates(n, [seed, shard, sub]) + bucket["_base"][0].as_py()
        bucket = bucket.append_column("_slot", pa.array(slots))
        return bucket.take(pa.array(np.argsort(slots))).select(out.names)

    return placed.groupBy("_shard", "_bucket").applyInArrow(permute, out)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One directory per shard; inside, files whose rows are in slot order by ranges of slots."""
    (
        shuffled.repartitionByRange("_shard", "_slot")
        .sortWithinPartitions("_shard", "_slot")
        .write.partitionBy("_shard")
        .parquet(path)
    )


def iter_slots(shuffled: DataFrame, shard: int, start: int = 0) -> Iterator:
    """Rows of one shard from a slot on, in order: where a reader that stopped goes on."""
    return shuffled.where((F.col("_shard") == shard) & (F.col("_slot") >= start)).orderBy("_slot").toLocalIterator()

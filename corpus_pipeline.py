"""From raw documents to shards of a training mix: each stage is one operator of ``tidewell.llm``.

``STAGES`` are run in order; each takes all that its predecessor kept and its result is written as Parquet and read again as
the next one's documents. All but the last return the columns of ``documents``, whatever other columns these have.

Every row is a document, whatever its ``doc_id``: ids may be null or repeated, so the middle stages number the rows and
choose them by number. Columns of the documents keep their names and values: what a stage makes takes a name that is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, minhash, mixing, quality, shuffle
from tidewell.llm.storage import free_names, table, written

N_SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut; learned from all labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "score")
    scores = quality.scored(docs, model, tuple(docs.columns), out=score)
    return scores.where(F.col(score) >= quality.CUT).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own in each row, written so that later reads find the same numbers, and the number's name."""
    (row,) = free_names(docs.columns, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the least id (null ids last), of each group of near-duplicates (five words, similarity 0.8)."""
    rows, row = numbered(docs)
    member = minhash.near_duplicates(rows, width=5, percent=80, key=row).select(F.col("doc_id").alias("node"), "component_id")
    ids = rows.select(F.col(row).alias("node"), F.col("doc_id").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node"))
    kept = member.join(ids, "node").groupBy("component_id").agg(least.alias("x")).select(F.col("x.node").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    rows, row = numbered(docs)
    found = decontaminate.contaminations(rows, table(spark, sf_dir, "benchmark"), key=row, short=True)
    found = found.select(F.col("doc_id").alias(row)).distinct()
    return rows.join(written(found, "contaminated"), row, "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once a copy taken."""
    rows, row = numbered(docs)
    return mixing.repeat_mix(rows, mixing.pareto_mix(rows, row=row), row).select(*docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mix with their ``shard`` and ``slot`` (with underscores at the end where the documents have such columns)."""
    shard, slot, grown = free_names(docs.columns, "shard", "slot", "grown_shard")
    return shuffle.external_shuffle(docs, N_SHARDS, names=(shard, grown, slot)).drop(grown)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("sharding", shard_stage),
]

#: The quality, MinHash and sharding stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs

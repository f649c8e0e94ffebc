"""Incremental forms of the batch operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.functions import fixed
from tidewell.operators import clusters
from tidewell.sources.raw import RAW_KEY, with_payload_hash


def landed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New landed documents as a stream of (path, body)."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def raw_landing(envelopes: DataFrame, delay: str | None = None) -> DataFrame:
    """A stream of envelopes without repeats of (source, job, payload hash); with ``delay`` the state forgets keys older than it."""
    rows = with_payload_hash(envelopes)
    if delay:
        return rows.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(RAW_KEY)
    return rows.dropDuplicates(RAW_KEY)


def incremental(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch through a batch function, e.g. the resolve and upsert operators; ``apply`` must be idempotent by batch id."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_crawl_totals(runs: DataFrame, width: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Counters by source and tumbling window; rows later than ``delay`` behind the newest are left out."""
    return (
        runs.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", width), "source_id")
        .agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("fetched_count").alias("fetched"))
        .select(F.col("window.start").alias("window_start"), "source_id", "runs", "failed", "fetched")
    )


def components_stream(links: DataFrame, path: str, checkpoint: str):
    """Links (u, v) as a stream into a log of component changes under ``path``, one directory a batch; read it by ``read_components``.

    A batch reads what the batches before it wrote and replaces its own directory, so a repeated batch changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        known = clusters.latest_components(component_log(batch.sparkSession, path).where(F.col("batch") < batch_id))
        clusters.merged_components(known, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return incremental(links, step, checkpoint)


def component_log(spark: SparkSession, path: str) -> DataFrame:
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], "node long, component long, batch long")
    return spark.read.schema("node long, component long, batch long").parquet(path)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    return clusters.latest_components(component_log(spark, path))


#: Parts into which the postings of a source fall, each a state of its own.
PARTS = 16


def crawl_rows(seen: DataFrame, crawls: DataFrame, parts: int = PARTS) -> DataFrame:
    """Input of ``stateful_freshness``: a row a posting seen, and for each successful crawl a row a part that closes it.

    ``seen``: source_id, seq, source_job_id, at; ``crawls``: source_id, seq, at. Rows: source_id, part, seq, source_job_id (null in the rows
    that close), at. A part is a hash of the posting, so a source of any size is many states; no crawl is gathered into a row.
    """
    rows = seen.select("source_id", F.pmod(F.xxhash64("source_job_id"), F.lit(parts)).cast("int").alias("part"), "seq", "source_job_id", "at")
    every = F.explode(F.array(*[F.lit(i) for i in range(parts)]))
    return rows.unionByName(crawls.select("source_id", every.alias("part"), "seq", F.lit(None).cast("string").alias("source_job_id"), "at"))


class FreshnessProcessor(StatefulProcessor):
    """Misses of each posting of a part of a source; see ``crawl_rows`` for the input. Output: postings seen, missed or expired.

    State holds the postings that are active, with the last crawl that has seen them and their misses; an expired one is
    put out once and forgotten. So a crawl costs what it has seen and what it misses of the crawls just before it, not the
    source's history. A crawl counts when its closing row comes; one that is not newer than the last one closed is ignored. A timer in
    event time clears a source that has not been crawled for ``forget``.
    """

    forget_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "source_job_id string", "seq long, missing_count int")
        self.last = handle.getValueState("last", "seq long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.last.get() if self.last.exists() else (None, None)
        closing, newest, seen = set(), 0, {}  # what one micro-batch brings for one part
        for batch in rows:
            fresh = batch if last is None else batch[batch["seq"] > last]
            ends = fresh["source_job_id"].isna()
            closing |= set(fresh.loc[ends, "seq"])
            for seq, jobs in fresh[~ends].groupby("seq")["source_job_id"]:
                seen.setdefault(seq, set()).update(jobs)
            if self.forget_ms and len(fresh):
                newest = max(newest, int(fresh["at"].max().timestamp() * 1000))
        out = []
        for seq in map(int, sorted(closing | seen.keys())):
            for job in seen.get(seq, ()):
                have = self.active.getValue((job,)) if self.active.containsKey((job,)) else (0, 0)
                self.active.updateValue((job,), (max(seq, have[0]), have[1]))
            if seq not in closing:
                continue
            last = seq
            for (job,), (at, count) in list(self.active.iterator()):
                count = 0 if at >= seq else count + 1
                out.append((*key[:1], job, seq, count, count < fixed.MISSES_TO_EXPIRE))
                if count < fixed.MISSES_TO_EXPIRE:
                    self.active.updateValue((job,), (at, count))
                else:
                    self.active.removeKey((job,))
        if self.forget_ms and newest:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(newest, (timer or 0) - self.forget_ms) + self.forget_ms
            self.handle.registerTimer(timer)
        if last is not None:
            self.last.update((last, timer))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "source_job_id", "seq", "missing_count", "active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.active.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


FRESHNESS = "source_id long, source_job_id string, seq long, missing_count int, active boolean"


def one_row_crawls(crawls: DataFrame, parts: int = PARTS) -> DataFrame:
    """Small crawls, one row each (source_id, seq, seen_ids), as rows of ``crawl_rows``."""
    seen = F.transform("seen_ids", lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(parts)).cast("int").alias("part"), x.alias("source_job_id")))
    ends = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(None).cast("string").alias("source_job_id")) for i in range(parts)])
    return crawls.select("source_id", "seq", F.lit(None).cast("timestamp").alias("at"), F.inline(F.concat(seen, ends)))


def stateful_freshness(rows: DataFrame, forget: str | None = None, forget_ms: int = 0) -> DataFrame:
    """Rows of ``crawl_rows`` (or of ``one_row_crawls``) to changed postings. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).

    With ``forget`` (a watermark delay) and ``forget_ms`` a source that has not been crawled for so long loses its state.
    """
    rows = one_row_crawls(rows) if "seen_ids" in rows.columns else rows
    processor = FreshnessProcessor()
    processor.forget_ms = forget_ms if forget else 0
    rows = rows.withWatermark("at", forget) if forget else rows
    return rows.groupBy("source_id", "part").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=FRESHNESS, outputMode="Update", timeMode="EventTime" if forget else "None",
    )

"""State that is carried on between micro-batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import asof, clusters
from tidewell.streaming import stream


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_carried_on_equal_one_run(spark):
    r = random.Random(4)
    batches = [[(r.randrange(120), r.randrange(120)) for _ in range(25)] for _ in range(4)] + [[(500, 500), (None, 3)], [(7, 500)], []]
    log, done = [], []
    for n, batch in enumerate(batches):
        known = clusters.latest_components(spark.createDataFrame(log, "node long, component long, batch long"))
        changed = [tuple(x) for x in clusters.merged_components(known, spark.createDataFrame(batch, "u long, v long")).collect()]
        before = components(done)
        done += [x for x in batch if None not in x]
        after = components(done)
        assert sorted(changed) == sorted((k, c) for k, c in after.items() if before.get(k) != c)  # only what is new or renamed
        log += [(*x, n) for x in changed]
    final = clusters.latest_components(spark.createDataFrame(log, "node long, component long, batch long"))
    assert {x["node"]: x["component"] for x in final.collect()} == components(done)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    first, second = (spark.createDataFrame(x, "u long, v long") for x in ([(1, 2), (5, 6)], [(2, 5)]))
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        known = clusters.latest_components(stream.component_log(spark, path).where(F.col("batch") < batch_id))
        clusters.merged_components(known, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    assert {tuple(x) for x in stream.read_components(spark, path).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1)}
    assert stream.component_log(spark, path).where("batch = 1").count() == 2  # 5 and 6


def crawl_frames(spark, crawls):
    seen = spark.createDataFrame([(s, q, j, f"2024-01-{d:02d}") for s, q, d, jobs in crawls for j in jobs], "source_id long, seq long, source_job_id string, at string")
    ends = spark.createDataFrame([(s, q, f"2024-01-{d:02d}") for s, q, d, _ in crawls], "source_id long, seq long, at string")
    return stream.crawl_rows(*(x.withColumn("at", F.col("at").cast("timestamp")) for x in (seen, ends)), parts=3)


def run(spark, path, crawls, n, **options):
    rows = crawl_frames(spark, crawls)
    rows.write.parquet(f"{path}/in/{n}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    out = stream.stateful_freshness(source, **options)
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/{n}-{i}")).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").schema(stream.FRESHNESS).parquet(f"{path}/out")
    return {tuple(x) for x in found.collect() if x["seq"] in {c[1] for c in crawls}}


def test_a_crawl_costs_what_it_sees_and_misses(spark, rocks, tmp_path):
    jobs = [f"j{i}" for i in range(20)]
    run(spark, str(tmp_path), [(1, 1, 1, jobs), (2, 1, 1, ["z"])], 0)
    assert run(spark, str(tmp_path), [(1, 2, 2, jobs[:3])], 1) == {(1, j, 2, 0, True) for j in jobs[:3]} | {(1, j, 2, 1, True) for j in jobs[3:]}
    assert run(spark, str(tmp_path), [(1, 3, 3, jobs[:4])], 2) == {(1, j, 3, 0, True) for j in jobs[:4]} | {(1, j, 3, 2, False) for j in jobs[4:]}
    assert run(spark, str(tmp_path), [(1, 4, 4, jobs[:2])], 3) == {(1, j, 4, 0, True) for j in jobs[:2]} | {(1, j, 4, 1, True) for j in jobs[2:4]}  # none of those that expired
    assert run(spark, str(tmp_path), [(1, 4, 5, jobs)], 4) == {(1, j, 4, 0, True) for j in jobs[:2]} | {(1, j, 4, 1, True) for j in jobs[2:4]}  # late: as before
    assert run(spark, str(tmp_path), [(1, 5, 6, jobs[10:11])], 5) >= {(1, "j10", 5, 0, True), (1, "j2", 5, 2, False)}  # one comes back


def test_a_silent_source_is_forgotten(spark, rocks, tmp_path):
    options = {"forget": "1 day", "forget_ms": 5 * 86_400_000}
    run(spark, str(tmp_path), [(1, 1, 1, ["a"]), (2, 1, 1, ["b"])], 0, **options)
    run(spark, str(tmp_path), [(2, 2, 20, ["b"])], 1, **options)
    got = run(spark, str(tmp_path), [(1, 7, 21, ["c"])], 2, **options)
    assert got == {(1, "c", 7, 0, True)}  # "a" is no miss: the source began anew


def test_asof_join_equals_brute_force(spark):
    r = random.Random(9)
    right = [(r.choice("abc") if i % 9 else None, r.choice([None, *range(40)]), r.randrange(5), f"v{i}") for i in range(120)]
    left = [(i % 50, r.choice("abcd") if i % 11 else None, r.choice([None, *range(45)])) for i in range(300)] + [(7, "a", 20)] * 3
    df = asof.asof_join(
        spark.createDataFrame(left, "id long, k string, t long").repartition(5), spark.createDataFrame(right, "k string, seen long, rank long, name string"), "k", "t", "seen", ("rank", "name"), ties=("rank", "name"),
    )

    def newest(k, t):
        found = [(s, n, name) for rk, s, n, name in right if rk == k and k is not None and t is not None and s is not None and s <= t]
        return max(found) if found else None

    got = sorted((x["id"], x["k"] or "", -1 if x["t"] is None else x["t"], x["asof"] and tuple(x["asof"])) for x in df.collect())
    want = sorted((i, k or "", -1 if t is None else t, newest(k, t)) for i, k, t in left)
    assert list(map(repr, got)) == list(map(repr, want))


def test_asof_join_makes_no_more_rows_than_both_sides(spark):
    urls = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") % 7).alias("t"), "id")
    shots = spark.range(100).select(F.lit("hot").alias("k"), (F.col("id") % 9).alias("seen"), F.col("id").alias("n"))
    df = asof.asof_join(urls, shots, "k", "t", "seen", ("n",), ties=("n",))
    assert df.count() == 4000 and df.where("asof.seen <> t").count() == 0
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("_part" in line for line in joins)

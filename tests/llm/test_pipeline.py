import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import mixing, quality, shuffle

from . import brute


def test_pipeline_equals_plain_stages(spark, tmp_path):
    r = random.Random(1)
    w = brute.by_first_words(900, 2)
    item = " ".join(w[:20])
    docs, labels = [], []
    for i in range(160):
        text = " ".join(r.choices(w[20:], k=60)).capitalize() + "."
        if i % 8 == 0:
            text = " | ".join(r.choices(w[20:], k=60)) + " !!"
        if i % 11 == 0:
            text += " " + item
        if i % 13 == 0 and i:
            text = docs[i - 1][1]
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, 0 if "|" in text else 1, 0))
    docs += [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(docs, brute.DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.fit(df, spark.read.parquet(str(tmp_path / "labels.parquet")))
    score = {x["doc_id"]: x["score"] for x in quality.scored(df, model).collect()}
    left = {d[0]: d for d in docs if score[d[0]] >= quality.CUT}
    comp = brute.components({i: brute.shingle_set(d[1], 5) for i, d in left.items()}, 80)
    left = {i: d for i, d in left.items() if comp[i] == i}
    bad = {d for d, _ in brute.contaminations({i: d[1] for i, d in left.items()}, {1: item})}
    left = {i: d for i, d in left.items() if i not in bad}
    mix = mixing.pareto_mix(spark.createDataFrame(list(left.values()), brute.DOCS)).collect()
    want = sorted(x["doc_id"] for x in mix for _ in range(x["copies"]))
    assert sorted(x["doc_id"] for x in out) == want
    assert {c for c in out[0].asDict()} == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
    slots = brute.grouped((x["shard"], x["slot"]) for x in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not any("|" in (x["text"] or "") for x in out)


def test_stages_take_null_and_repeated_ids(spark, tmp_path):
    w = brute.by_first_words(900, 3)
    item = " ".join(w[:20])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = random.Random(2)
    text = [" ".join(r.choices(w[20:], k=40)) for _ in range(8)]
    rows = [(1, text[0], "a"), (1, text[0], "a"), (1, text[1], "a"), (None, text[2], "a"), (None, text[3], "b"), (2, text[3], "b"), (None, text[4] + " " + item, "b"), (3, text[5], "a"), (3, text[6] + " " + item, "a"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], brute.DOCS)
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())
    left = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    whole = Counter((i, t) for i, t, _ in rows)
    assert seen(left) == Counter({x: 1 for x in whole if x != (None, text[3])})
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert seen(clean) == Counter({x: n for x, n in whole.items() if item not in (x[1] or "")})
    many = spark.createDataFrame([(7 if i % 2 else None, f"w{i} x y", "en", "s", 1) for i in range(60)], brute.DOCS)
    mixed = seen(stages["mixing sources to target weights"](spark, many, str(tmp_path)))
    assert set(mixed) == {(7 if i % 2 else None, f"w{i} x y") for i in range(60)}
    assert set(mixed.values()) == {1, 2} and sum(mixed.values()) == 90
    equal = spark.createDataFrame([(7, "same text", "en", "s", 1)] * 300 + [(7, f"t{i}", "en", "s", 1) for i in range(300)], brute.DOCS)
    sent = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be broadcast
    for df in (equal.repartition(3), equal.coalesce(1)):
        moved = shuffle.external_shuffle(df, 4, bucket_bytes=1 << 9)
        out = moved.select("*", F.spark_partition_id().alias("part")).collect()
        assert sorted(x["_slot"] for x in out) == list(range(600)) and len({x["_shard"] for x in out}) == 1
        assert max(Counter(x["part"] for x in out).values()) < 400
        sent.append(sorted((x["_slot"], x["text"]) for x in out))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sent[0] == sent[1]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9, "en", f"s{i % 2}", 1) for i in range(20)], brute.DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    names = ("score", "_text", "body", "row", "_row", "copies", "_copy", "shard", "slot", "_slot", "doc", "size", "node", "kept", "component_id")
    clash = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "not in there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in stages.items():
        out = stage(spark, clash, str(tmp_path))
        made = ["shard_", "slot_"] if name == "sharding" else []
        assert out.columns == clash.columns + made
        rows = out.collect()
        assert rows and all(x[n] == f"{n}-{x['doc_id']}" for x in rows for n in names)
        assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0

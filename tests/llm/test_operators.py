import base64
import hashlib
import os
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, langid, minhash, mixing, quality, queries, shuffle, storage, suffixdedup, textarrays, topk, trainorder, urlfilter

from . import brute

LONG = " ".join(brute.by_first_words(6000, 9))


def frame(spark, rows, extra=()):
    """Documents with columns whose names the operators use themselves."""
    data = [(i, t, "en", s, 0, 7, "x") for i, t, s in rows]
    return spark.createDataFrame(data, brute.DOCS + ", score int, component string")


@pytest.fixture(scope="module")
def odd():
    w = brute.by_first_words(400)
    base = " ".join(w[:120])
    near = " ".join(w[:60] + ["changed"] + w[61:120])
    rows = [(1, base, "a"), (2, near, "a"), (3, base, "b"), (4, None, None), (5, "", "b"), (6, " \t\n", "a"), (7, "one two", "a"), (8, "One  TWO", "c")]
    rows += [(9, " ".join(w[200:300]), "a"), (10, " ".join(w[200:300] + w[300:310]), "a"), (11, LONG, "a"), (12, LONG + " end", "b"), (13, "spam " * 300, "c"), (14, "naïve ñandú 日本", "c")]
    return rows


def test_words_and_shingles():
    column = pa.array(["A b\x0bC", None, "", "one", "  x y  z w v "])
    _, _, data, offsets = next(textarrays.slices(column))
    w = textarrays.Words(data, offsets)
    assert np.diff(w.first).tolist() == [3, 0, 0, 1, 5]
    _, first = w.shingles(4)
    assert np.diff(first).tolist() == [1, 0, 0, 1, 2]
    same = pa.array(["a b c", "A B C", "a b d"])
    (_, sets), = textarrays.shingle_sets(same, 4)
    assert sets[0].tolist() == sets[1].tolist() != sets[2].tolist()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((5, 3), (40, 30), (900, 700)):
        codes = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        a, b = codes[:n], codes[n - shared :]
        s = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.2
        assert np.array_equal(s[0], minhash.superminhash(a[::-1].copy(), np.zeros(n, int), 1)[0])
        assert sorted(np.floor(s[0]).astype(int))[0] == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, odd, width):
    r = random.Random(3)
    rows = list(odd)
    hub = brute.by_first_words(80, 4)
    for i in range(30):  # a group around one text, with and without links among its members
        w = list(hub)
        for _ in range(i % 4):
            w[r.randrange(80)] = f"edit{i}"
        rows.append((100 + i, " ".join(w), "a"))
    out = {x["doc_id"]: x for x in minhash.near_duplicates(frame(spark, rows), width=width).collect()}
    sets = {i: brute.shingle_set(t, width) for i, t, _ in rows}
    want = brute.components(sets, 80)
    assert {i: x["component_id"] for i, x in out.items()} == want
    assert all(out[i]["n_shingles"] == len(s) and out[i]["kept"] == (want[i] == i) for i, s in sets.items())


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_second_round_links_without_a_pivot(spark):
    """A bucket's least text may be near to none, while others in it are near each other."""
    w = brute.by_first_words(400, 5)
    texts = {1: w[:100], 2: w[20:130], 3: w[22:132]}
    rows = [(i, " ".join(t), "a") for i, t in texts.items()]
    out = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert out == brute.components({i: brute.shingle_set(" ".join(t), 5) for i, t in texts.items()}, 80)


def test_rows_of_one_id_have_links_of_their_own(spark):
    w = brute.by_first_words(200, 6)
    a, b = " ".join(w[:60]), " ".join(w[100:160])
    rows = [(1, a), (1, b), (2, b + " word"), (None, a + " more"), (None, "alone in here somewhere"), (None, None), (3, a)]
    out = minhash.near_duplicates(frame(spark, [(i, t, "a") for i, t in rows]))
    assert Counter((x["doc_id"], x["component_id"], x["kept"]) for x in out.collect()) == Counter(
        [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (None, None, True), (3, 1, False)]
    )


@pytest.mark.parametrize("cells", [decontaminate.BROADCAST_CELLS, 0])
def test_contaminations_equal_brute_force(spark, monkeypatch, cells):
    """With the items broadcast, and with a shuffle of all sides that deals hot shingles and items over tasks."""
    monkeypatch.setattr(decontaminate, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(decontaminate, "SAMPLE_ONE_IN", 1)
    w = brute.by_first_words(300, 1)
    items = {1: " ".join(w[:30]), 2: " ".join(w[40:60]), 3: "Two words", 4: None, 5: "  ", 6: " ".join(w[:30])}
    edited = w[:15] + ["EDIT"] + w[16:30]
    docs = {
        1: " ".join(w[100:140] + w[:30] + w[140:150]), 2: " ".join(w[200:210]) + " " + " ".join(w[40:60]).upper(), 3: " ".join(edited), 4: None, 5: "",
        6: "so TWO  words here", 7: " ".join(w[:28]), 8: " ".join(w[150:250]), 9: LONG + " " + " ".join(w[:30]), 10: " ".join(w[:29] + ["last"]), 11: "two two words words",
    }
    d = frame(spark, [(i, t, "a") for i, t in docs.items()])
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.contaminations(d, b).collect()}
    assert out == pytest.approx(brute.contaminations(docs, items))
    assert decontaminate.contaminations(d, b.limit(0)).count() == 0
    assert decontaminate.contaminations(d.limit(0), b).count() == 0


def test_contaminations_at_edges_and_out_of_line(spark):
    w = brute.by_first_words(500, 5)
    n, o = w[:38], w[100:160]
    items = {1: " ".join(n), 2: " ".join(o)}
    bodies = [
        w[200:250] + n[:37], w[200:250] + n[:36], n[1:] + w[200:250], n[2:] + w[200:250], n[:2] + n[3:] + w[200:250], w[200:250] + n[:35] + n[36:],
        w[200:250] + o[1:30] + ["x", "y"] + o[30:59] + w[250:260], w[200:250] + o[30:] + o[:30] + w[250:260], w[200:250] + n[4:30] + w[250:300],
    ]
    docs = {i: " ".join(b) for i, b in enumerate(bodies)}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = lambda rows, **k: {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.contaminations(frame(spark, rows), b, **k).collect()}
    want = brute.contaminations(docs, items)
    assert {d for d, _ in want} == set(range(8))
    assert found([(i, t, "a") for i, t in docs.items()]) == pytest.approx(want)
    # rows of one id, null among them, each in its own text; documents shorter than the item only if asked for
    rows = [(None, docs[8], "a"), (None, docs[0], "a"), (None, docs[0], "a"), (20, docs[1], "a"), (20, docs[8], "a"), (21, " ".join(n[:37]), "a"), (22, " ".join(n[:30]), "a"), (23, " ".join(n[:4]), "a")]
    long = {(None, 1): want[0, 1], (20, 1): want[1, 1]}
    assert found(rows) == pytest.approx(long)
    assert found(rows, short=True) == pytest.approx(long | {(21, 1): 33 / 34})


def test_radius_keeps_what_is_similar_and_marks_select(spark):
    """Recall of the radius among pairs of exact similarity 0.8 and more, and the pairs that are looked at."""
    r = random.Random(8)
    w = brute.by_first_words(3000, 11)
    items = {i: r.choices(w, k=40) for i in range(60)}
    docs, sim = {}, {}
    for i, t in items.items():
        for e in range(3):
            own = list(t)
            for p in r.sample(range(2, 38), e):
                own[p] = f"edit{p}"
            docs[3 * i + e] = own
            a, b = brute.shingle_set(" ".join(t), 5), brute.shingle_set(" ".join(own), 5)
            sim[3 * i + e] = len(a & b) / len(a | b)
    table = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "item_id long, text string")
    known = decontaminate.item_table(table(items)).cache()
    prints = decontaminate.item_table(table(docs)).select(F.col("item_id").alias("id"), F.col("n_words").alias("n"), "codes", "fingerprint")
    marks = decontaminate.item_marks(known, 0.8)
    found = {(x["id"], x["item_id"]) for x in decontaminate.met(prints, known, marks).collect()}
    true = {(d, d // 3) for d, s in sim.items() if s >= 0.8}
    assert len(true) > 60 and len(found & true) >= 0.99 * len(true)
    assert len(found) <= 2 * len(docs)  # of 60 times as many pairs of one size


def test_blocks_cover_the_fingerprint():
    edges = decontaminate.block_edges(19)
    assert len(edges) == 20 and sum(n for _, n in edges) == 64 and all(n > 0 for _, n in edges)


def test_repeats_equal_brute_force(spark):
    r = random.Random(2)
    w = brute.by_first_words(500, 7)
    passage = " ".join(w[:40])
    texts = [None, "", "short", passage, "x " + passage + " y", "ab" * 120, "z" * 400, passage + passage, "é" * 90, "pre é" * 3 + passage[:150]]
    for i in range(12):
        cut = r.randrange(100)
        texts.append(" ".join(w[50 + cut : 120 + cut]) + ("" if i % 3 else passage[r.randrange(60) :]))
    docs = [(i, t) for i, t in enumerate(texts)]
    out = {x["doc_id"]: x for x in suffixdedup.remove_repeats(frame(spark, [(i, t, "a") for i, t in docs]), with_text=True).collect()}
    for i, gone in brute.repeats(docs, 100).items():
        raw = (docs[i][1] or "").encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (out[i]["n_bytes"], out[i]["n_removed"], bytes(out[i]["kept"])) == (len(raw), sum(gone), kept), i
        assert out[i]["n_spans"] == len([x for x in gone.split(b"\0") if x])
    assert suffixdedup.remove_repeats(frame(spark, [])).count() == 0


def test_stretches_seen_in_a_slice_are_those_after_the_first_place():
    anchor = np.array([7, 7, 7, 8, 7, 9], dtype=np.int64)
    content = np.array([1, 1, 1, 1, 2, 3], dtype=np.int64)
    docs = np.array([5, 4, 4, 4, 4, 1], dtype=np.int64)
    starts = np.array([0, 30, 30, 30, 60, 0], dtype=np.int64)
    texts = np.zeros(6, dtype=np.int64)
    assert suffixdedup._seen(anchor, content, docs, texts, starts).tolist() == [True, False, False, False, False, False]
    texts[2] = 1  # another text of the same id is a place of its own
    assert suffixdedup._seen(anchor, content, docs, texts, starts).tolist() == [True, False, True, False, False, False]
    none = np.zeros(0, dtype=np.int64)
    assert suffixdedup._seen(none, none, none, none, none).tolist() == []


def test_rows_of_a_null_id_are_kept_whole(spark):
    text = " ".join(brute.by_first_words(60, 3))
    out = suffixdedup.remove_repeats(frame(spark, [(None, text, "a"), (1, text, "a"), (2, text, "a"), (None, None, "a")])).collect()
    n = len(text.encode())
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"]) for x in out) == sorted([("1", n, 0), ("2", n, n), ("None", n, 0), ("None", 0, 0)])


def test_rows_of_one_id_do_not_repeat_each_other(spark):
    text = " ".join(brute.by_first_words(60, 3))
    out = suffixdedup.remove_repeats(frame(spark, [(1, text, "a"), (1, text, "a"), (2, text, "a")])).collect()
    assert sorted((x["doc_id"], x["n_removed"]) for x in out) == [(1, 0), (1, 0), (2, len(text.encode()))]


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    w = brute.by_first_words(900, 11)
    a, b, other = " ".join(w[:60]), " ".join(w[30:90]), " ".join(w[300:420])
    rows = [(1, b), (2, a), (2, other), (2, "short text"), (2, other[:140]), (None, a), (None, other), (3, "x " + other[50:260]), (3, a + " " + b), (2, a), (2, None)]
    places = sorted({(i, xxhash.xxh64_intdigest(t, 42), t) for i, t in rows if i is not None and t}, key=lambda x: (x[0], (x[1] + (1 << 63)) % (1 << 64)))
    gone = brute.repeats([(n, t) for n, (_, _, t) in enumerate(places)], 100)
    want = {(i, t): bytes(c for c, g in zip(t.encode(), gone[n], strict=True) if not g) for n, (i, _, t) in enumerate(places)}
    out = suffixdedup.remove_repeats(frame(spark, [(i, t, "a") for i, t in rows]), with_text=True).collect()
    kept = Counter((x["doc_id"], x["n_bytes"], bytes(x["kept"])) for x in out)
    assert kept == Counter((i, len((t or "").encode()), want.get((i, t), (t or "").encode())) for i, t in rows)


def test_loser_tree_merges_runs():
    r = random.Random(1)
    strings = ["".join(r.choice("ab") for _ in range(8)).encode() for _ in range(200)]
    runs = []
    for i in range(5):
        own = sorted((s, (0, p)) for p, s in enumerate(strings) if p % 5 == i)
        shared, last = [], b""
        for s, _ in own:
            h = 0
            while h < min(len(s), len(last)) and s[h] == last[h]:
                h += 1
            shared.append(h)
            last = s
        runs.append(iter([(s, h, p) for (s, p), h in zip(own, shared, strict=True)]))
    merged = list(suffixdedup.merge_runs(runs, 8))
    assert [m[2] for m in merged] == sorted(strings)
    for (_, _, a), (h, _, b) in zip(merged, merged[1:], strict=False):
        assert a[:h] == b[:h] and (h == 8 or a[h] != b[h])
    firsts = {}
    for h, place, s in merged:
        if h < 8:
            firsts[s] = place
    assert all(firsts[s] == (0, strings.index(s)) for s in set(strings))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)) * rng.choice([0.05, 0.5, 1.0], size=(300, 1))
    v[20:30] = v[20]  # ties
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0, 2.0]), (450, [0.0] * 8)]
    df = spark.createDataFrame([(i, a, 1, 2) for i, a in rows], "vec_id long, embedding array<float>, rank int, score int")
    good = {i: np.floor(256 * np.array(a, dtype=np.float32).astype(float)) for i, a in rows if a is not None and all(x is not None and np.isfinite(x) for x in a)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-float(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:5]
        want |= {(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(scores)}
    out = topk.norm_bucket_topk(df, df.where("vec_id % 50 = 0"), k=5, bucket_rows=64, block_rows=4)
    assert {tuple(x) for x in out.collect()} == want
    assert topk.norm_bucket_topk(df.limit(0), df.limit(0)).count() == 0
    large = [(i, [float(x) for x in rng.normal(size=3) * 1e7]) for i in range(1, 9)] + [(50, [1e7, 2e7, -1e7]), (51, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    out = {x["vec_id"]: x["score"] for x in topk.norm_bucket_topk(df, df.where("vec_id = 50"), k=9).collect()}
    q = {i: [int(np.floor(256 * x)) if x < 1e30 else (1 << 63) - 1 for x in v] for i, v in large}
    assert out == {i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, q[50], strict=True)))) for i, v in q.items() if i != 50}


def test_cells_are_those_that_some_query_reaches(spark):
    buckets = spark.createDataFrame([(i, 100.0 - 10 * i) for i in range(10)], "bucket int, top double")
    blocks = spark.createDataFrame([(0, 0.0), (1, 55.0), (2, 99.0), (3, 1000.0), (4, 100.0)], "block int, least double")
    out = Counter(x["block"] for x in topk.reached_cells(buckets, blocks).collect())
    assert out == {0: 10, 1: 5, 2: 1, 4: 1}  # 17 of 50 cells


def test_shuffle_follows_the_key_law(spark, odd):
    rows = odd + [(20 + i, f"t{i}", "a") for i in range(200)] + [(20, "t0", "a")]
    df = frame(spark, rows)
    out = shuffle.external_shuffle(df, 5, bucket_bytes=1 << 12).collect()
    assert Counter((x["doc_id"], x["text"]) for x in out) == Counter((i, t) for i, t, _ in rows)
    slots = defaultdict(list)
    for x in out:
        slots[x["_shard"]].append(x["_slot"])
        assert x["_grown_shard"] in (x["_shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shuffle.external_shuffle(df.repartition(7), 5, bucket_bytes=1 << 12).collect()
    key = lambda x: (x["_shard"], x["_slot"], x["doc_id"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    order = [x["doc_id"] for x in sorted((x for x in out if x["_shard"] == 0), key=lambda x: x["_slot"])]
    assert order != sorted(order)
    assert shuffle.external_shuffle(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        shuffle.external_shuffle(df.withColumn("_slot", F.lit(1)), 5)


def test_shards_are_written_and_resumed(spark, tmp_path):
    df = frame(spark, [(i, f"t{i}", "a") for i in range(100)])
    moved = shuffle.external_shuffle(df, 3)
    shuffle.write_shards(moved, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    rest = [x["_slot"] for x in shuffle.iter_slots(back, 1, start=5)]
    assert rest == list(range(5, back.where("_shard = 1").count()))


def test_mix_meets_its_targets(spark):
    r = random.Random(0)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), f"s{r.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(600)]
    rows += [(700, None, "s0"), (701, "", None), (702, "a b c", None), (703, "only", "z")]
    df = frame(spark, rows)
    out = {x["doc_id"]: x for x in mixing.pareto_mix(df).collect()}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        n = len(brute.words(t))
        assert out[i]["size"] == n and out[i]["taken"] in (0, n, 2 * n)
        sizes[s] += n
        taken[s] += out[i]["taken"]
    want = brute.targets(dict(sizes), mixing.WEIGHTS, mixing.SHARE, 2)
    for i, _, s in rows:
        assert out[i]["source_size"] == sizes[s] and out[i]["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 3 for s in ("s0", "s1", "s2", "s3", "s4"))
    again = {x["doc_id"]: x["taken"] for x in mixing.pareto_mix(df.repartition(9)).collect()}
    assert again == {i: x["taken"] for i, x in out.items()}
    copies = Counter(x["doc_id"] for x in mixing.repeat_mix(df, mixing.pareto_mix(df)).collect())
    assert all(copies[i] == x["copies"] for i, x in out.items())
    assert mixing.pareto_mix(df.limit(0)).count() == 0


def test_draw_is_unequal_and_in_proportion_to_size(spark):
    """500 sources of the same sizes are 500 draws: a document's rate is its inclusion probability, and the odds decide the order."""
    sizes = [*range(2, 82, 2), 400]
    rows = [(s * 100 + j, " ".join(["w"] * n), f"s{s:03}") for s in range(500) for j, n in enumerate(sizes)]
    out = mixing.pareto_mix(frame(spark, rows), weights=(1.0,)).collect()
    rest = sum(sizes) / 2
    # the largest is certain; the others share what it leaves
    c = (rest - 400) / sum(n * n for n in sizes[:-1])
    rate = Counter(x["doc_id"] % 100 for x in out if x["copies"] == 2)
    assert rate[40] == 500 and all(x["copies"] in (1, 2) for x in out)
    for j, n in enumerate(sizes[:-1]):
        # a source has 41 documents only: what closes the last gap is a small one
        assert n < 20 or abs(rate[j] / 500 - c * n) < 0.1, (n, rate[j] / 500, c * n)
    assert sum(rate[j] for j in range(30, 40)) > 1.8 * sum(rate[j] for j in range(10, 20))
    taken = Counter()
    for x in out:
        taken[x["doc_id"] // 100] += x["taken"]
    assert all(abs(t - 1.5 * sum(sizes)) <= 5 for t in taken.values())


def test_mix_of_repeated_rows_and_long_texts(spark):
    """A document larger than what is left is passed over; equal rows are drawn one by one; names do not clash."""
    rows = [(1, LONG, "a")] + [(i, f"w{i} b c d", "a") for i in range(2, 400)] + [(None, "same words here", "a")] * 30
    df = spark.createDataFrame([(i, t, s, "c", 9) for i, t, s in rows], "doc_id long, text string, source string, copies string, copy int").withColumn("row", F.monotonically_increasing_id())
    mix = mixing.pareto_mix(df, weights=(1.0,), share=0.2, row="row")
    x = mix.agg(F.sum("taken"), F.first("target")).first()
    assert abs(x[0] - x[1]) <= 4 and x[1] < 6000
    out = mixing.repeat_mix(df, mix, "row")
    assert out.columns == df.columns and out.count() == mix.agg(F.sum("copies")).first()[0]


def test_native_operators_need_no_python_worker(tmp_path):
    """The two native queries end where no Python worker can be started at all."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.pyspark.python', '/no/such/python').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', 'file://' + sys.argv[2] + '/ck').getOrCreate()\n"
        "spark.sql(\"SELECT 1L AS page_id, 'http://www.example.com/en/x' AS url\").write.parquet(sys.argv[2] + '/pages.parquet')\n"
        "long = ' '.join(f'w{i}' for i in range(30))\n"
        "spark.sql(f\"SELECT 1L AS doc_id, '{long} more' AS text\").write.parquet(sys.argv[2] + '/documents.parquet')\n"
        "spark.sql(f\"SELECT 1L AS item_id, '{long}' AS text\").write.parquet(sys.argv[2] + '/benchmark.parquet')\n"
        "from tidewell.llm import queries as q\n"
        "print('ROWS', q.op8_url_sweep(spark, sys.argv[2]).count(), q.op7_simhash_windows(spark, sys.argv[2]).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK")} | {"PYSPARK_PYTHON": "/no/such/python", "PYSPARK_DRIVER_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1 1" in said.stdout, said.stderr[-2000:]


CONTRACTS = {
    "op1_bradley_terry": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_string_kernel": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_norm_bucket_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_external_shuffle": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_pareto_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_url_sweep": "page_id bigint, host string, path string, rule string, verdict string",
    "op9_suffix_merge": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_superminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_keep_their_contract(spark, name):
    """Names and types, one row a document, and what of a row the contract fixes."""
    where = "/root/testdata/sf0.001"
    if not os.path.exists(where):
        pytest.skip("no test tables here")
    out = queries.QUERIES[name](spark, where)
    types = dict(out.dtypes)
    assert {c: types[c] for c in (f.split()[0] for f in CONTRACTS[name].split(", "))} == dict(f.split() for f in CONTRACTS[name].split(", "))
    docs = {x["doc_id"]: x for x in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = out.collect()
    if "doc_id" not in types:
        return
    assert sorted(x["doc_id"] for x in rows) == sorted(docs)
    for x in rows:
        raw = (docs[x["doc_id"]]["text"] or "").encode()
        crc = zlib.crc32(str(x["doc_id"]).encode())
        if name.startswith("op1_"):
            assert x["held_out"] == (crc % 5 == 0) and x["predicted"] == int(x["score"] >= 0.3) and 0 <= x["score"] <= 1
        if name.startswith("op3_"):
            assert x["held_out"] == (crc % 4 == 2) and x["lang_pred"] in ("und", *{d["lang"] for d in docs.values()})
        if name.startswith("op5_"):
            assert (x["size"], x["text_crc32"], x["law"]) == (len(raw) + 16, zlib.crc32(raw), "key") and x["grown_shard"] in (x["shard"], 40)
            assert x["shard"] == max(range(40), key=lambda i: _spark_hash(shuffle.SEED, i, x["doc_id"]))
        if name.startswith("op6_"):
            assert x["size"] == len(brute.words(docs[x["doc_id"]]["text"])) and x["taken"] in (0, x["size"], 2 * x["size"])
        if name.startswith("op9_"):
            assert x["n_bytes"] == len(raw) and (x["n_removed"] or x["kept_sha256"] == hashlib.sha256(raw).hexdigest())
        if name.startswith("op10_"):
            assert x["kept"] == (x["doc_id"] == x["component_id"])


def _spark_hash(seed: int, shard: int, doc: int) -> int:
    """xxhash64(seed, shard, doc) as Spark chains it, from 42 on, signed."""
    h = 42
    for value, form in ((seed, "<i"), (shard, "<i"), (doc, "<q")):
        h = xxhash.xxh64_intdigest(struct.pack(form, value), h)
    return h - (1 << 64) if h >> 63 else h


def test_url_rules_equal_brute_force(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("a.b.example.com", "/", "block"), ("com", "/x/", "block"), ("org", "/", "block")]
    urls = dict(enumerate([
        "https://www.Example.com/en/1", "http://example.com/en/", "http://example.com/en", "http://notexample.com/en/x", "http://x.example.com/en/a?b#c", "http://www.example.com/de/", "https://q.net/es/a", "https://net/fr/1",
        "https://a.net/FR/1", None, "", "no scheme", "://com/x/1", "http://a.b.example.com", "http://c.a.b.example.com/en/", "http://b.example.com/x/", "http://com.evil.dev/", "http://ex.org?u=/en/", "http://ex.org#f", "a://b://com/", "http://example.com:80/en/1",
    ]))
    df = spark.createDataFrame([(i, u, "old", 1, i) for i, u in urls.items()] + [(0, urls[0], "old", 1, 0)], "page_id long, url string, verdict string, key int, _host long")
    for n in (1, 200_000):
        swept = urlfilter.sweep(df.select(urlfilter.host_key(urlfilter.host_of("url")).alias("key")).distinct(), urlfilter.rule_table(spark, rules), n)
        assert swept.count() == df.select(urlfilter.host_of("url")).distinct().count()
    out = urlfilter.filter_urls(df, urlfilter.rule_table(spark, rules)).collect()
    assert len(out) == len(urls) + 1 and all(x["_host"] == x["page_id"] and x["key"] == 1 for x in out)
    assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in out} == brute.verdicts(urls, rules)
    # one host with a third of the pages, all null urls another key
    many = spark.range(9000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://www.example.com/en/").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".net/fr/"))).alias("url"))
    got = urlfilter.filter_urls(many, urlfilter.rule_table(spark, rules)).groupBy("rule").count().collect()
    assert {x["rule"]: x["count"] for x in got} == {"www.example.com/en/": 3000, None: 3000, "net/fr/": 3000}
    assert urlfilter.filter_urls(df.limit(0), urlfilter.rule_table(spark, rules)).count() == 0
    assert {x["verdict"] for x in urlfilter.filter_urls(df, urlfilter.rule_table(spark, ())).collect()} == {"allow"}


def test_a_hot_key_is_dealt_over_parts(spark):
    """A third of the rows has one key: joins give the same rows, and no partition holds more than a part of the key."""
    n, parts = 30_000, 64
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.select("k").distinct().withColumn("f", F.explode(F.array(F.lit("a"), F.lit("b"))))
    counts = rows.groupBy("k").agg(F.count("*").alias("_n"))
    out = storage.salted_join(rows, facts.repartition("k"), ["k"], counts, F.col("id"))
    assert sorted(map(tuple, out.select("id", "f").collect())) == [(i, f) for i in range(n) for f in "ab"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = storage.salted_join(rows, facts, ["k"], counts, F.col("id"))
        largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert largest < 4 * 2 * n / parts


def test_training_order_is_a_permutation_and_round_trips(spark, odd, tmp_path):
    df = frame(spark, odd + [(1, odd[0][1], "a")])
    out = trainorder.training_order(df, length=64, shard_sequences=16)
    rows = out.collect()
    n = len(rows)
    assert sorted(x["slot"] for x in rows) == list(range(n)) and [x["slot"] for x in rows] != sorted(x["doc_id"] for x in rows)
    assert all(x["shard"] == x["slot"] // 16 and x["offset"] == x["slot"] % 16 * 65 and len(x["tokens"]) == 64 for x in rows)
    text = defaultdict(dict)
    for x in rows:
        text[x["doc_id"]][x["part"]] = np.frombuffer(x["tokens"], "u1")[: x["n_tokens"]]
    for i, t, _ in odd:
        ids = np.concatenate([text[i][p] for p in range(len(text[i]))])
        assert bytes(ids[:-1]) == (t or "").encode() and ids[-1] == trainorder.END
    by_slot = {x["slot"]: bytes(x["tokens"]) for x in rows}
    # the order does not depend on how the table lies
    again = trainorder.training_order(df.repartition(7, F.rand(1)), length=64, shard_sequences=16).collect()
    assert {x["slot"]: bytes(x["tokens"]) for x in again} == by_slot
    path = str(tmp_path / "o")
    index = trainorder.write_shards(df, path, length=64, shard_sequences=16)
    assert {(x["slot"], x["offset"], x["doc_id"], x["part"]) for x in index.collect()} == {(x["slot"], x["offset"], x["doc_id"], x["part"]) for x in rows}
    files = trainorder.shard_files(spark, path).collect()
    assert sorted(x["shard"] for x in files) == list(range(-(-n // 16))) and sum(x["length"] for x in files) == n * 65
    assert [x.tobytes() for x in trainorder.read_slots(spark, path, 10, 30, 64, shard_sequences=16)] == [by_slot[s] for s in range(10, 40)]
    stored = {x["slot"]: x["crc32"] for x in trainorder.stored_sequences(spark, path, 64, shard_sequences=16).collect()}
    assert stored == {s: zlib.crc32(b) for s, b in by_slot.items()}
    assert trainorder.training_order(df.limit(0)).count() == 0


def test_training_order_by_a_rank_file(spark, tmp_path):
    place = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(place):
        pytest.skip("no vocabulary file here")
    pattern = r"\w+|\s+|[^\w\s]+"
    texts = {1: "Some words, and 123 more.", 2: None, 3: "naïve ñandú 日本 \U0001f600"}
    tokens = partial(trainorder.rank_file_tokens, place, pattern)
    rows = trainorder.training_order(frame(spark, [(i, t, "a") for i, t in texts.items()]), 8, "<u2", tokenise=tokens, end=50256, pad=65535).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(place, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, t in texts.items():
        own = sorted((x for x in rows if x["doc_id"] == i), key=lambda x: x["part"])
        ids = np.concatenate([np.frombuffer(x["tokens"], "<u2")[: x["n_tokens"]] for x in own]).tolist()
        assert ids[-1] == 50256 and plain.decode(ids[:-1]) == (t or "")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 5000])
def test_feistel_walks_stay_inside(spark, n):
    slots = trainorder.with_slots(spark.range(n).withColumnRenamed("id", "number"), n).select("slot").toPandas()["slot"]
    assert sorted(slots) == list(range(n))


def test_languages_are_told_apart(spark):
    vocab = {"xx": brute.by_first_words(200, 1), "yy": ["".join(reversed(w)) + "qz" for w in brute.by_first_words(200, 2)]}
    r = random.Random(5)
    data = [(i, " ".join(r.choices(vocab[k], k=30)), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 60)]
    data += [(900, None, "xx", "s", 0), (901, "", "xx", "s", 0), (902, "12 !! \n", "yy", "s", 0), (905, "\U0001f600 7", "yy", "s", 0), (903, "é", None, "s", 0), (904, LONG, None, "s", 0)]
    df = spark.createDataFrame(data, brute.DOCS).withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(df.where("doc_id % 2 = 0 or doc_id < 80"))
    out = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    assert np.mean([out[i]["lang_pred"] == k for i, _, k, _, _ in data[:120]]) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 905)] == ["und"] * 4 and out[903]["lang_pred"] in vocab and out[904]["lang_pred"] in vocab
    assert all(0 <= x["score"] <= 1 for x in out.values())
    assert {x["lang_pred"] for x in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_quality_ranks_pairs_and_cuts_at_the_quantile(spark):
    r = random.Random(6)
    w = brute.by_first_words(300, 8)
    good = [(2 * i, " ".join(r.choices(w, k=40)).capitalize() + ".", 1) for i in range(120)]
    bad = [(2 * i + 1, " | ".join(r.choices(w, k=40)) + " !!!", 0) for i in range(40)]
    rows = good + bad
    odd = [(900, None), (901, ""), (902, " \n"), (903, LONG)]
    df = frame(spark, [(i, t, "a") for i, t, _ in rows] + [(i, t, "a") for i, t in odd])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels.where("doc_id % 5 <> 0"))
    out = {x["doc_id"]: x["score"] for x in quality.scored(df, model).collect()}
    assert len(out) == len(rows) + 4 and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= quality.CUT) == (q == 1) for i, _, q in rows]) > 0.97
    assert out[900] == out[901]
    one_kind = quality.fit(df, labels.where("quality = 1"))
    assert {round(x["score"], 9) for x in quality.scored(df, one_kind).collect()} == {quality.CUT}
    assert quality.scored(df.limit(0), model).count() == 0

"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

An item of n words is compared with windows of n words of a document. Texts are lower-cased (A-Z) words between ASCII
white space; their shingles are runs of five words (an item of fewer words: all of them). A window can reach the similarity
only if enough of its shingles are those of items of its size, whatever their order, and the first of the best windows begins
with the document or ends with such a shingle (else the window one word before it is as good): windows are laid at those
places, at the edges of a document too. Every such window gets a 64-bit SimHash of its shingles. The fingerprint is cut into RADIUS + 1
blocks: two fingerprints within RADIUS bits agree in one block at least, so the items with an equal block hold every item
within the radius. At this similarity blocks are 3 or 4 bits wide and let most items of a size through, so they are looked up
only among the items that a window meets: of an item's shingles the rarest so many that a similar window must have one of them
are its marks, and a window goes with the items of whose marks it has one. What is within the radius is verified by the exact
weighted similarity: the sum of the lesser over the sum of the greater multiplicities of all shingles of either side.

Fingerprints of texts of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9: RADIUS leaves
out less than one pair in a thousand of those, and practically none above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import salted_join, written

WIDTH = 5
MIN_SIMILARITY = 0.8
RADIUS = 19
#: A table of items is broadcast up to so many numbers (8 bytes each); a larger one is joined by a shuffle with hot keys dealt
#: over tasks. Those of the documents' shingles are found on one row in SAMPLE_ONE_IN, which decides where rows go and no result.
BROADCAST_CELLS = 1 << 20
SAMPLE_ONE_IN = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text; none for null."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def coded(text: str) -> Column:
    """The words of a text, each as a 64-bit hash."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingles(word: str, width: int) -> Column:
    """The 64-bit codes of every run of ``width`` coded words, in order."""
    n = F.size(word) - width + 1
    at = lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(word), i + j) for j in range(width)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(codes: Column) -> Column:
    """64 bits: bit b is set where most codes (each as often as it occurs) have bit b set."""
    vote = lambda b: F.aggregate(codes, F.lit(0), lambda s, c: s + F.getbit(c, b).cast("int") * 2 - 1)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(vote(b) > 0, b).otherwise(F.lit(-1)))
    # shiftleft with a column count is in SQL only; the sum of distinct powers is the bitwise or
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.when(b >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def block_edges(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 blocks of 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks(fingerprint: str, radius: int) -> Column:
    """(block number, value) of each block."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), lo).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("value"))
            for i, (lo, n) in enumerate(block_edges(radius))
        ]
    )


def with_bag(df: DataFrame) -> DataFrame:
    """``df`` with ``bag``: a hash of each of ``codes`` and its number among its equals, so that bags meet as sets do."""
    df = df.withColumn("_s", F.array_sort("codes"))
    df = df.withColumn("_at", F.expr("filter(sequence(0, size(_s) - 1), i -> i = 0 or get(_s, i) <> get(_s, i - 1))"))
    each = "transform(sequence(0, coalesce(get(_at, j + 1), size(_s)) - p - 1), k -> xxhash64(get(_s, p), k))"
    return df.withColumn("bag", F.expr(f"flatten(transform(_at, (p, j) -> {each}))")).drop("_s", "_at")


def item_marks(known: DataFrame, min_similarity: float) -> DataFrame:
    """(n, code, item_id): the rarest shingles of each item, as many as leave out too few for the similarity.

    A similar window has at least ``min_similarity`` of an item's shingles, so of any ``size - need + 1`` of them it has one.
    """
    codes = known.select("item_id", "n_words", F.size("codes").alias("size"), F.explode("codes").alias("code"))
    often = codes.groupBy("n_words", "code").agg(F.count_distinct("item_id").alias("items"))
    ranked = codes.join(often, ["n_words", "code"]).groupBy("item_id", "n_words").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("items", "code"))).alias("x"))
    spare = (F.col("size") - F.ceil(F.col("size") * min_similarity - 1e-9) + 1).cast("int")
    return ranked.select("item_id", F.col("n_words").alias("n"), F.explode(F.array_distinct(F.slice("x", F.lit(1), spare))["code"]).alias("code")).distinct()


def _placed(k: int) -> Column:
    """(pos, code, width) of each shingle of ``k`` words."""
    return F.transform(shingles("w", k), lambda c, i: F.struct(i.alias("pos"), c.alias("code"), F.lit(k).alias("width")))


def item_table(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(item_id, n_words, width, codes, fingerprint) of the items that have words."""
    split = items.select(F.col(item).alias("item_id"), coded(text).alias("w")).where(F.size("w") > 0)
    each = [
        split.where(F.least(F.size("w"), F.lit(width)) == k).select("item_id", F.size("w").alias("n_words"), F.lit(k).alias("width"), shingles("w", k).alias("codes"))
        for k in range(1, width + 1)
    ]
    return with_bag(reduce(DataFrame.unionByName, each).distinct().withColumn("fingerprint", simhash(F.col("codes"))))


def _small(table: DataFrame, cells: Column) -> bool:
    """Whether a table of items may be broadcast, by the sum of the numbers that its rows hold."""
    return table.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0] <= BROADCAST_CELLS


def met(prints: DataFrame, known: DataFrame, marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, n, hamming): windows and the items of their size that they have a mark of, agree with in a block, and lie near."""
    items = marks.join(known.select("item_id", F.col("n_words").alias("n"), F.col("fingerprint").alias("item_print")), ["item_id", "n"])
    codes = prints.select("id", "n", "fingerprint", F.explode(F.array_distinct("codes")).alias("code"))
    if _small(items, F.lit(4)):
        pairs = codes.join(F.broadcast(items), ["n", "code"])
    else:
        pairs = salted_join(codes, items, ["n", "code"], codes.groupBy("n", "code").agg(F.count("*").alias("_n")), F.col("id"))
    pairs = pairs.where(F.exists(F.zip_with(blocks("fingerprint", radius), blocks("item_print", radius), lambda x, y: x["value"] == y["value"]), lambda same: same))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print")))
    return pairs.select("id", "item_id", "n", distance.alias("hamming")).where(F.col("hamming") <= radius).distinct()


def contaminations(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, radius: int = RADIUS, min_similarity: float = MIN_SIMILARITY, short: bool = False,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each document for each item it holds.

    Null, empty and blank texts and items match nothing. Repeated items match each by itself; rows of one id (null is an id too)
    are searched each in its own text and the best window of all is given; ties between windows go to the first. A document
    shorter than an item has no window of its size; with ``short`` it is one window by itself (``n_words`` is then its own size).
    An empty table on either side gives an empty result, and other columns are not read.
    """
    known = written(item_table(items, item, item_text, width, radius), "benchmark-items")
    widths = [r[0] for r in known.select("width").distinct().collect()]  # 1 to ``width`` numbers
    # sizes of the items that have a shingle, one row each, whatever the number of items that have it there
    sizes = written(known.select(F.col("n_words").alias("n"), "width", F.explode("codes").alias("code")).distinct(), "benchmark-shingles")
    marks = written(item_marks(known, min_similarity), "benchmark-marks")
    # rows of one id are told apart by their text
    named = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    split = named.select("doc_id", "body", coded("text").alias("w"))
    if not widths:
        return split.select("doc_id", F.lit(None).cast(known.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity")).limit(0)
    placed = lambda texts: texts.select("doc_id", "body", F.size("w").alias("size"), F.inline(F.concat(*[_placed(k) for k in widths])))
    if _small(sizes, F.lit(3)):
        hits = placed(split).join(F.broadcast(sizes), ["width", "code"])
    else:
        sample = named.sample(1 / SAMPLE_ONE_IN, seed=1).select("doc_id", "body", coded("text").alias("w"))
        often = written(placed(sample).groupBy("width", "code").agg(F.count("*").alias("_n")), "benchmark-often")
        hits = salted_join(placed(split), sizes, ["width", "code"], often, F.col("body"))
    hits = hits if short else hits.where("size >= n")
    hits = hits.groupBy("doc_id", "body", "n", "width", "size").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    # both / (a + b - both) >= s needs both >= s * (a + b) / (1 + s); a window has at most ``_own`` shingles
    need = F.ceil(min_similarity * (F.col("n") - F.col("width") + 1 + F.col("_own")) / (1 + min_similarity) - 1e-9)
    hits = hits.withColumn("_own", F.least("n", "size") - F.col("width") + 1).withColumn("_need", F.greatest(F.lit(1), need).cast("int"))
    ends = "filter(sequence(_need - 1, size(p) - 1), j -> get(p, j - _need + 1) > get(p, j) - _own)"
    starts = F.expr(f"array_distinct(transform({ends}, j -> greatest(0, get(p, j) - _own + 1)))")
    windows = hits.where("_need <= _own and size(p) >= _need").select("doc_id", "body", F.explode(starts).alias("start"), "n", "width")
    windows = written(windows, "benchmark-windows")
    # the windows of a text in one row beside it: the words are cut once more, for those texts only
    per_doc = windows.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "n", "width")).alias("ws")).withColumnsRenamed({"doc_id": "_doc", "body": "_body"})
    texts = named.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body")))
    texts = texts.select("doc_id", "body", coded("text").alias("w"), "ws")
    cut = reduce(
        DataFrame.unionByName,
        [
            texts.select("doc_id", "body", F.size("w").alias("size"), F.expr(f"filter(ws, x -> x.width = {k})").alias("ws"), shingles("w", k).alias("codes"))
            .select("doc_id", "body", "size", F.explode("ws").alias("x"), "codes")
            .select("doc_id", "body", F.col("x.start").alias("start"), F.col("x.n").alias("n"), F.least("x.n", "size").alias("own"), F.slice("codes", F.col("x.start") + 1, F.col("x.n") - k + 1).alias("codes"))
            for k in widths
        ],
    )
    prints = cut.withColumn("fingerprint", simhash(F.col("codes")))
    prints = written(with_bag(prints).withColumn("id", F.xxhash64("doc_id", "body", "start", "n")), "benchmark-prints")
    near = written(met(prints, known, marks, radius), "benchmark-near")
    windows_ = near.join(prints.select("id", "doc_id", "start", "own", F.col("bag").alias("a")), "id")
    bags = known.select("item_id", F.col("n_words").alias("n"), F.col("bag").alias("b"))
    if _small(known, F.size("bag") + 2):
        sides = windows_.join(F.broadcast(bags), ["item_id", "n"])
    else:
        sides = salted_join(windows_, bags, ["item_id", "n"], near.groupBy("item_id", "n").agg(F.count("*").alias("_n")), F.col("id"))
    both = F.size(F.array_intersect("a", "b"))  # the sum of lesser multiplicities
    judged = sides.withColumn("_both", both).withColumn("similarity", F.col("_both") / (F.size("a") + F.size("b") - F.col("_both")))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start", F.col("own").alias("n"), "hamming"))
    return (
        judged.where(F.col("similarity") >= min_similarity)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("x"))
        .select("doc_id", "item_id", F.col("x.start").alias("start_word"), F.col("x.n").alias("n_words"), F.col("x.hamming").alias("hamming"), (-F.col("x.s")).alias("similarity"))
    )

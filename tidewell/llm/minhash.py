"""Near-duplicates by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash gives every shingle a random permutation of the signature's places; at step j each shingle offers
j + (a random fraction) to its j-th place, and each place keeps its least offer. The ranks of one shingle are thus
correlated, which lowers the variance, and once no place holds more than j + 1, later steps cannot change anything:
the loop stops early, after one or two steps for a text of ordinary length.

Texts with equal shingle sets are one class; only classes are banded. In a bucket the least class is the pivot and
each other member is verified against it, on full sets. For members that are still apart after that, the number of shingles
that each shares with any of them bounds its similarity to every one of them. Those that these bounds leave open are
verified bucket by bucket, and a bucket block by block: a task holds two blocks of texts and counts all
intersections by one matrix product, and puts out of the links that it finds as many as join its texts' groups. No link between
classes that share a bucket is passed over, and no pairs are written but such links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.clusters import connected_components

from .storage import hot_join, written
from .textarrays import Words, mix64, shingle_sets, slices

#: 32 bands of 4 places: two texts of similarity 0.8 share no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Partners of one pivot that a task verifies at a time.
CELL = 500
#: Texts of a block of the second round, and shingles of a slab of its matrix product.
BLOCK, _COLUMNS = 256, 1 << 14
_CHUNK = 1 << 16


def superminhash(codes: np.ndarray, row: np.ndarray, n_rows: int, places: int = PLACES) -> np.ndarray:
    """(n_rows, places) signatures from shingle codes (uint64) and the row of each; rows without codes stay infinite."""
    best = np.full(n_rows * places, np.inf)
    for lo in range(0, len(codes), _CHUNK):
        code, own = codes[lo : lo + _CHUNK], row[lo : lo + _CHUNK]
        deal = None
        for j in range(places):
            draw = mix64(code + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            offer = j + (draw >> np.uint64(32)).astype(np.float64) / 4294967296.0
            at = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
            if deal is None:
                place, first = at, at
            else:
                if j == 1:  # the permutations as far as the first step has dealt them
                    deal = np.tile(np.arange(places, dtype=np.int16), (len(code), 1))
                    each = np.arange(len(code))
                    deal[each, first], deal[:, 0] = 0, first
                each = np.arange(len(code))
                place = deal[each, at].astype(np.int64)
                deal[each, at] = deal[:, j]
                deal[:, j] = place
            np.minimum.at(best, own * places + place, offer)
            touched = own[np.flatnonzero(np.diff(own, prepend=-1))]
            done = np.zeros(n_rows, dtype=bool)
            done[touched] = best.reshape(n_rows, places)[touched].max(axis=1) < j + 1
            keep = ~done[own]
            if not keep.any():
                break
            code, own = code[keep], own[keep]
            if j == 0:
                first, deal = first[keep], True
            else:
                deal = deal[keep]
    return best.reshape(n_rows, places)


def _signatures(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch["text"]):
            codes, first = Words(data, offsets).shingles(width)
            sets = [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if sets else codes
            rows = np.repeat(np.arange(hi - lo), sizes)
            ranks = superminhash(flat, rows, hi - lo)
            # 16 bits of each place; four places are one band's key of 8 bytes
            with np.errstate(invalid="ignore"):
                short = mix64(np.where(np.isfinite(ranks), ranks, 0.0).view(np.uint64)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c].slice(lo, hi - lo) for c in ("doc_id", "ta", "tb")],
                    pa.array(sizes.astype(np.int64)),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                names=["doc_id", "ta", "tb", "n_shingles", "class_key", "signature"],
            )


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, ta, tb, text): two hashes of a text find it again, whatever ids are null or repeated."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), F.col(text)).alias("tb"), F.col(text).alias("text"))


def signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    return hashed(docs, key, text).mapInArrow(
        partial(_signatures, width), "doc_id long, ta long, tb long, n_shingles long, class_key binary, signature binary"
    )


def _verify(width: int, percent: int, key: tuple, pivots: pa.Table, others: pa.Table) -> pa.Table:
    """The partners of one pivot whose full shingle sets are near enough."""
    hit: list[int] = []
    if pivots.num_rows and others.num_rows:
        (_, (base,)) = next(shingle_sets(pivots["pivot_text"].slice(0, 1).combine_chunks(), width))
        ids = others["other"].to_numpy()
        for lo, sets in shingle_sets(others["text"].combine_chunks(), width):
            for i, s in enumerate(sets):
                if len(s) and 100 * min(len(s), len(base)) >= percent * max(len(s), len(base)):
                    at = np.minimum(np.searchsorted(base, s), len(base) - 1)
                    both = int((base[at] == s).sum())
                    if 100 * both >= percent * (len(s) + len(base) - both):
                        hit.append(int(ids[lo + i]))
    return pa.table({"u": pa.array([key[0].as_py()] * len(hit), pa.int64()), "v": pa.array(hit, pa.int64())})


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts' full shingle sets reach the similarity.

    Partners of a pivot are dealt into cells of about ``CELL``, each with its own copy of the pivot's text, so a pivot
    with very many partners is spread over tasks.
    """
    share = written(pairs.groupBy("u").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "minhash-shares")
    dealt = hot_join(pairs, share, "u", "n", pairs.count(), merge=True).withColumn("cell", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int"))
    others = dealt.join(texts, dealt.v == texts.doc_id).select(F.col("u"), "cell", F.col("v").alias("other"), "text")
    pivots = share.join(texts, share.u == texts.doc_id).select(
        F.col("u").alias("p"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c"), F.col("text").alias("pivot_text")
    )

    def verify(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return _verify(width, percent, key, left, right)

    return pivots.groupBy("p", "c").cogroup(others.groupBy("u", "cell")).applyInArrow(verify, "u long, v long")


def _codes(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["rep"].to_numpy()
        for lo, sets in shingle_sets(batch["text"], width):
            rows = np.repeat(ids[lo : lo + len(sets)], [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "code"])


def shared_shingles(reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, common): how many of a text's shingles some other text of ``reps`` has too, summed by shingle and never paired."""
    codes = texts.join(reps, texts.doc_id == reps.rep).select("rep", "text").mapInArrow(partial(_codes, width), "rep long, code long")
    holders = codes.groupBy("code").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    alone = holders.where("rep = last").groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = codes.groupBy("rep").agg(F.count("*").alias("size"))
    return sizes.join(alone, "rep", "left").select("rep", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _forest(near: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links in ``near`` (a matrix of texts) as many as join the same groups: one less than the groups of each part."""
    a, b = np.nonzero(near)
    names, g = np.unique(group, return_inverse=True)
    link = np.full((len(names), len(names)), -1, dtype=np.int64)
    link[g[a], g[b]] = link[g[b], g[a]] = np.arange(len(a))
    new, kept = np.ones(len(names), dtype=bool), []
    for start in range(len(names)):
        reached = [start] if new[start] else []
        new[start] = False
        while reached:
            now = reached.pop()
            found = np.flatnonzero((link[now] >= 0) & new)
            new[found] = False
            kept += link[now][found].tolist()
            reached += found.tolist()
    return a[kept], b[kept]


def _block_links(width: int, percent: int, key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the texts of two blocks (or within one) that are in different groups yet: as many as join these groups."""
    rows = rows.combine_chunks()
    ids, group, block = (rows[c].to_numpy() for c in ("rep", "g", "block"))
    sets = [s for _, part in shingle_sets(rows["text"], width) for s in part]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    shared = often > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = row[kept], place[column[kept]]
    for lo in range(0, int(shared.sum()), _COLUMNS):  # a slab of shingles at a time
        here = (column >= lo) & (column < lo + _COLUMNS)
        slab = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        slab[row[here], column[here] - lo] = 1
        both += slab @ slab.T
    whole = sizes[:, None] + sizes[None, :] - both
    near = np.triu(100 * both >= percent * whole, 1) & (group[:, None] != group[None, :])
    i, j = key[1].as_py(), key[2].as_py()
    if i != j:
        near &= block[:, None] != block[None, :]
    a, b = _forest(near, group)
    return pa.table({"u": pa.array(ids[a]), "v": pa.array(ids[b])})


def block_links(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links among open classes (bucket, rep, g) of which some bucket holds both, without those that close a circle.

    Every link is looked at; a task puts out those that join its groups, fewer than its rows, as only the groups that hang together matter. A bucket is dealt into blocks of about ``BLOCK`` texts, and each two blocks meet in one task: tasks are bounded however
    large a bucket is. Of buckets that hold the same classes (near copies share most of their bands) one is enough.
    """
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    sets = open_.groupBy("bucket").agg(F.count("*").alias("m"), mark("rep").alias("h"), mark(F.lit(1), F.col("rep")).alias("i"))
    sets = sets.groupBy("m", "h", "i").agg(F.min("bucket").alias("bucket")).select("bucket", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    sets = written(sets, "minhash-bucket-sets")
    rows = hot_join(open_.select("bucket", "rep", "g"), sets, "bucket", "m", open_.count())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(texts, F.col("rep") == texts.doc_id)
    cells = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "g", "block", "text")

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _block_links(width, percent, key, table)

    return cells.groupBy("bucket", "i", "j").applyInArrow(links, "u long, v long").distinct()


def _by_bucket(rows: DataFrame, per_bucket: DataFrame, name: str) -> DataFrame:
    """``rows`` with facts of their bucket: sums by bucket are made in parts, and a bucket of very many rows is not shuffled whole."""
    return hot_join(rows, written(per_bucket, name), "bucket", "m", rows.count(), merge=True)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents are linked where 100 * shared >= percent * all of their distinct word shingles (lower-cased A-Z, words between
    ASCII white space; a text of fewer words than ``width`` is one shingle). Null and blank texts have no shingle and
    no link: each is a component by itself. Every row is a document: rows that repeat an id have each their own text and
    links. The component id is the least id reachable (null only where no row of the component has an id), and a row is kept
    if that is its own. Equal texts are one class and so one component; a very long text is one set; an empty table gives an
    empty result; other columns are not read.
    """
    signed = written(signatures(docs, width, key, text), "minhash-signatures")
    full = signed.where("n_shingles > 0")
    # a class is a set of shingles: it has a number, its least id, and the row whose text stands for it
    row = F.first(F.struct(F.col("doc_id").alias("id"), F.col("ta").alias("a"), F.col("tb").alias("b"), F.col("n_shingles").alias("n"), "signature"))
    classes = full.groupBy("class_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"), row.alias("x"))
    classes = written(classes.select("class_key", "least", "docs", "x.*").withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    bands = classes.select(
        "rep", "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("signature", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))),
    ).select("rep", "n", F.xxhash64("pos", "col").alias("bucket"))
    pivots = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pivot_n")).where("m > 1")
    shared = written(_by_bucket(bands, pivots, "minhash-pivots"), "minhash-buckets")
    # the classes that share a bucket grow with the corpus: both sides are shuffled, once, and later joins read this table
    wanted = shared.select("rep").distinct().join(classes.select("rep", "docs", F.col("id").alias("_id"), F.col("a").alias("ta"), F.col("b").alias("_b")), "rep")
    texts = hot_join(hashed(docs, key, text), written(wanted, "minhash-wanted"), "ta", "docs", signed.count(), merge=True)
    texts = texts.where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tb") == F.col("_b"))).select(F.col("rep").alias("doc_id"), "text")
    texts = written(texts.dropDuplicates(["doc_id"]), "minhash-texts")
    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    first = shared.where((F.col("rep") != F.col("pivot")) & near(F.col("n"), F.col("pivot_n"))).select(
        F.col("pivot").alias("u"), F.col("rep").alias("v")
    )
    links = written(verified(written(first.distinct(), "minhash-pairs"), texts, width, percent), "minhash-links")
    groups = written(connected_components(links), "minhash-groups")
    # buckets whose members are not one group yet: every pair across groups that was not tried
    named = shared.select("bucket", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("g")), "minhash-named", shared)
    several = named.groupBy("bucket").agg(F.count("*").alias("m"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("bucket", "m")
    mixed = written(_by_bucket(named, several, "minhash-several").drop("m"), "minhash-mixed", named)
    mixed = mixed.join(written(shared_shingles(mixed.select("rep").distinct(), texts, width), "minhash-shared"), "rep")
    # x and y share at most what either shares with anyone, so y may have at most ``limit`` shingles (and x at most y's limit)
    mixed = mixed.withColumn("limit", F.floor(F.col("common") * (100 + percent) / percent) - F.col("n")).where(F.col("common") * 100 >= F.col("n") * percent)
    mixed = written(mixed, "minhash-bounded")
    bounds = mixed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("limit").alias("most"))
    mixed = _by_bucket(mixed, bounds, "minhash-bounds").where("limit >= least and n <= most").select("bucket", "rep", "g")
    mixed = written(mixed, "minhash-open")
    more = written(block_links(mixed, texts, width, percent), "minhash-links")
    if not more.isEmpty():
        groups = written(connected_components(links.union(more)), "minhash-groups")
    member = classes.select("class_key", "docs", "least", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("g", F.coalesce("component", "rep"))
    ids = member.groupBy("g").agg(F.min("least").alias("component_id"))
    member = written(member.join(ids, "g").select("class_key", "docs", "component_id"), "minhash-members")
    found = hot_join(full.select("doc_id", "n_shingles", "class_key"), member, "class_key", "docs", signed.count(), merge=True).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

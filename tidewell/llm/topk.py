"""Exact top-k search by norm-bucketed retrieval.

Vectors are put in order of length and cut into buckets of neighbours in that order. A query needs, from a bucket whose
longest vector has length m, a cosine of at least t = best-so-far / (length of query * m): the local threshold. If t is
above 1 the bucket is skipped whole; if t is small, vectors too short to reach it are skipped (length pruning); else
the bucket's sorted coordinate lists give the feasible range of the query's strongest coordinates, and the list with
the fewest vectors is taken (coordinate pruning). What is left is verified by exact integer products.

Two waves: the first takes the one bucket of the longest vectors and yields each query's k-th best score so far. With it,
queries are put in order of the length that they need and cut into blocks; the second wave sends a bucket's vectors only
to the blocks that they can reach, and a query only to the buckets that can reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import numbered, written

#: Vectors of a bucket, queries of a block: together the largest cell that a task holds.
BUCKET_ROWS = 16_384
BLOCK_ROWS = 16_384
#: Products below this are exact in floats.
EXACT = float(1 << 53)
#: Below this local cosine threshold coordinate ranges are too wide to prune.
LENGTH_ONLY = 0.3
FOCUS = 6
SLACK = 1e-9


def usable(vector: str) -> F.Column:
    """True for vectors without null or non-finite components (and not null themselves)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: str, scale: int = 256) -> F.Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class _Bucket:
    """One bucket, with unit vectors and sorted coordinate lists for pruning."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.rows = rows
        self.ids = ids
        self.length = np.sqrt((rows * rows).sum(1))
        self.longest = float(self.length.max(initial=0.0))
        self.unit = rows / np.maximum(self.length, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        self.by_length = np.argsort(-self.length, kind="stable")
        self.neg_length = -self.length[self.by_length]

    def candidates(self, query: np.ndarray, bound: float) -> np.ndarray:
        """Positions that may reach ``bound``, equality included."""
        every = self.by_length
        q_len = float(np.sqrt((query * query).sum()))
        if not np.isfinite(bound) or bound <= 0 or q_len == 0 or self.longest == 0:
            return every if bound <= 0 or not np.isfinite(bound) else every[:0]
        t = bound / (q_len * self.longest) - SLACK
        if t > 1:
            return every[:0]
        long_enough = every[: np.searchsorted(self.neg_length, -(bound / q_len) * (1 - SLACK), "right")]
        if t < LENGTH_ONLY:
            return long_enough
        q = query / q_len
        focus = np.argsort(-np.abs(q))[:FOCUS]
        half = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - q[focus] ** 2)))
        lo, hi = t * q[focus] - half - SLACK, t * q[focus] + half + SLACK
        # beyond the point where the vector lies within the threshold's cone the range runs to the end
        lo = np.where(q[focus] <= -t, -2.0, lo)
        hi = np.where(q[focus] >= t, 2.0, hi)
        cuts = [(np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right"), f) for f, a, b in zip(focus, lo, hi, strict=True)]
        left, right, f = min(cuts, key=lambda c: c[1] - c[0])
        return self.order[left:right, f] if right - left < len(long_enough) else long_enough


def _by_dimension(rows: pa.Table, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, positions, ids, vectors as rows of integers)."""
    rows = rows.combine_chunks()
    sizes = pc.list_value_length(rows["q"]).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = rows["q"].take(pa.array(at)).combine_chunks().flatten().to_numpy()
        yield int(size), at, rows[name].to_numpy()[at], flat.reshape(len(at), size)


def _cell(k: int, vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """The k best of one bucket for each query of one block, as far as they reach the query's bound."""
    asked_ids, found_ids, scores = [], [], []
    if vectors.num_rows and queries.num_rows:
        asked = {size: (at, ids, q) for size, at, ids, q in _by_dimension(queries, "query_id")}
        bounds = queries["bound"].to_numpy()
        for size, _, ids, whole in _by_dimension(vectors, "vec_id"):
            if size not in asked:
                continue
            bucket = _Bucket(ids, whole.astype(np.float64))
            for at, q_id, q_whole in zip(*asked[size], strict=True):
                q, bound = q_whole.astype(np.float64), bounds[at]
                near = bucket.candidates(q, bound)
                near = near[ids[near] != q_id]
                if not len(near):
                    continue
                if bucket.longest * float(np.sqrt((q * q).sum())) < EXACT:
                    score = (bucket.rows[near] @ q).astype(np.int64)
                else:  # products beyond what floats hold: integers of any size, cut to a long at last
                    score = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in whole[near].astype(object) @ q_whole.astype(object)], dtype=np.int64)
                own = ids[near]
                reach = score >= bound * (1 - SLACK) if bound > 0 else score >= bound
                score, own = score[reach], own[reach]
                if len(score) > 4 * k:  # keep all that tie with the k-th
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    score, own = score[score >= least], own[score >= least]
                best = np.lexsort((own, ~score))[:k]
                asked_ids.append(np.full(len(best), q_id))
                found_ids.append(own[best])
                scores.append(score[best])
    put = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.table({"query_id": put(asked_ids), "vec_id": put(found_ids), "score": put(scores)})


def reached_cells(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(bucket, block, least): the buckets (bucket, top) whose longest vector reaches what some query of a block (block, least) needs.

    Buckets are numbered from the longest vectors on, so a block reaches those up to a last one. It is found in one sorted
    sweep over both catalogues (a row a bucket or block): no bucket is set against all blocks.
    """
    events = buckets.select((F.col("top") * (1 + SLACK)).alias("x"), F.lit(0).alias("kind"), "bucket", F.lit(None).cast("int").alias("block"), F.lit(None).cast("double").alias("least"))
    events = events.unionByName(blocks.select(F.col("least").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("bucket"), "block", "least"))
    sweep = Window.orderBy(F.desc("x"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = events.withColumn("last", F.max("bucket").over(sweep)).where("kind = 1 and last is not null")
    return last.select("block", "least", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bucket"))


def norm_bucket_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
    bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part. A row with the query's own id is never its
    answer. Vectors of another dimension than the query's are no candidates; an empty vector scores 0 with other empty ones.
    Repeated ids count once a distinct vector. Components beyond a long are the nearest long; products are exact
    integers, and such that a long cannot hold are the nearest that it can. A very long vector is one row of its bucket. Empty
    tables give an empty result; other columns are not read.
    """
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    base = (
        vectors.where(usable(vector))
        .select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector, scale).alias("q"))
        .where("vec_id is not null").distinct().withColumn("norm", square)
    )
    base = written(base, "topk-vectors")
    rows = base.count()
    bucket_rows = min(bucket_rows, max(1024, -(-rows // 64)))  # small tables are buckets too
    placed = numbered(base, "topk-order", F.col("norm").desc(), F.col("vec_id")).withColumn("bucket", F.floor(F.col("_nth") / bucket_rows).cast("int")).drop("_nth")
    placed = written(placed, "topk-buckets", base)
    asked = queries.where(usable(vector)).select(F.col(id_col).cast("long").alias("query_id"), quantised(vector, scale).alias("q"))
    asked = written(asked.where("query_id is not null").distinct().withColumn("qnorm", square), "topk-queries")
    n_blocks = max(1, -(-asked.count() // block_rows))
    buckets = written(placed.groupBy("bucket").agg(F.max("norm").alias("top")), "topk-catalogue")
    first = 0

    def visit(cells: DataFrame, bounded: DataFrame) -> DataFrame:
        """The best of each (bucket, block, least, top) cell; vectors and queries that a cell cannot need are not sent there."""
        left = placed.join(cells.select("bucket", "block", "least"), "bucket").where(F.col("norm") * (1 + SLACK) >= F.col("least"))
        right = bounded.join(cells.select("bucket", "block", "top"), "block").where(F.col("need") <= F.col("top") * (1 + SLACK))

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            return _cell(k, a, b)

        return (
            left.select(F.col("bucket").alias("b"), F.col("block").alias("c"), "vec_id", "q").groupBy("b", "c")
            .cogroup(right.select("bucket", "block", "query_id", "q", "bound").groupBy("bucket", "block"))
            .applyInArrow(best, "query_id long, vec_id long, score long")
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # every query against the one bucket of the longest vectors: its k-th score there is its bound
    unbound = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"), "bound": F.lit(float("-inf")), "need": F.lit(0.0)})
    some = buckets.where(F.col("bucket") == first).select("bucket", "top", F.lit(0.0).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    near = visit(some, unbound)
    near = written(near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "topk-first")
    kth = near.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("found"))
    bound = F.when(F.col("found") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf")))
    bounded = asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce(bound, F.lit(float("-inf"))))
    # the squared length that a vector must have to reach the bound; queries of like needs share a block
    need = F.when((F.col("bound") > 0) & (F.col("qnorm") > 0), F.col("bound") * F.col("bound") / F.col("qnorm") * (1 - SLACK)).otherwise(F.lit(0.0))
    bounded = bounded.withColumn("need", need).select("query_id", "q", "bound", "need")
    bounded = numbered(bounded, "topk-needs", F.col("need"), F.col("query_id")).withColumn("block", F.floor(F.col("_nth") / block_rows).cast("int")).drop("_nth")
    bounded = written(bounded, "topk-bounded")
    blocks = bounded.groupBy("block").agg(F.min("need").alias("least"))
    cells = reached_cells(buckets, blocks).where(F.col("bucket") != first).join(buckets, "bucket")
    rest = visit(written(cells, "topk-cells"), bounded)
    return (
        near.unionByName(rest).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

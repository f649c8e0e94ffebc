"""Ranked lexical search of many queries at once, with what queries share computed once a document.

A score is a sum of integer contributions, one a term of the query. Queries (items) are taken in blocks of bounded size. In a block
the terms of each item are put in the order of the number of items that hold them, and pairs of neighbours that occur in several items
become nodes, pairs of nodes too, until none is shared: a graph whose inner nodes are term sets that items have in common. For a
batch of documents each node is one row of partial scores, made once from the rows below it; an item adds up what is left
of its terms. Every task keeps the best documents of each item; these are few and are ranked at the end.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textarrays import Words, slices

#: Terms of the items of a block, repeats not counted; an item of more is a block of its own.
BLOCK_TERMS = 1 << 16
#: Cells of a batch's partial scores: documents times nodes.
CELLS = 1 << 22

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
OUTSIDE = ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms(text: str) -> Column:
    """The maximal runs of ASCII letters, digits and other characters; only A-Z become small."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), CAPITALS, CAPITALS.lower()), F.lit(TERM), F.lit(0))


@dataclass
class Program:
    """``leaves``: (term, times) of each leaf; ``pairs``: the two parts of each inner node, in an order in which they can be made; ``rests``: what each of ``items`` adds up."""

    terms: list[str]
    leaves: list[tuple[int, int]]
    pairs: list[tuple[int, int]]
    items: list[int]
    rests: list[list[int]]
    levels: list[np.ndarray] = field(default_factory=list)

    def additions(self) -> tuple[int, int]:
        """(with, without) sharing, a document."""
        size = [1] * len(self.leaves)
        for a, b in self.pairs:
            size.append(size[a] + size[b])
        apart = sum(max(0, sum(size[x] for x in rest) - 1) for rest in self.rests)
        return len(self.pairs) + sum(max(0, len(rest) - 1) for rest in self.rests), apart


def compile_block(items: dict[int, dict[str, int]]) -> Program:
    """The graph of a block from the terms of each item with their repeats."""
    held = Counter(leaf for bag in items.values() for leaf in bag.items())
    leaves = sorted(held, key=lambda leaf: (-held[leaf], leaf))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    names = sorted({t for t, _ in leaves})
    place = {t: i for i, t in enumerate(names)}
    rests = {i: sorted(number[leaf] for leaf in bag.items()) for i, bag in sorted(items.items())}
    pairs: list[tuple[int, int]] = []
    while True:
        count = Counter(pair for rest in rests.values() for pair in zip(rest, rest[1:], strict=False))
        most = max(count.values(), default=0)
        if most < 2:
            break
        # the commonest pairs first; of two that overlap in an item the commoner is made there
        chosen = sorted((p for p, n in count.items() if 2 * n > most and n > 1), key=lambda p: (-count[p], p))
        rank = {p: i for i, p in enumerate(chosen)}
        used: dict[int, int] = {}
        for item, rest in rests.items():
            there = sorted((rank[p], at) for at, p in enumerate(zip(rest, rest[1:], strict=False)) if p in rank)
            taken: dict[int, int] = {}
            for r, at in there:
                if not {at - 1, at, at + 1} & taken.keys():
                    taken[at] = r
            if taken:
                rests[item] = [(-1 - taken[at] if at in taken else x) for at, x in enumerate(rest) if at - 1 not in taken]
                for r in taken.values():
                    used.setdefault(r, len(leaves) + len(pairs) + len(used))
        pairs += [chosen[r] for r in used]
        rests = {item: [used[-1 - x] if x < 0 else x for x in rest] for item, rest in rests.items()}
    return Program(names, [(place[t], n) for t, n in leaves], pairs, list(rests), list(rests.values()), _levels(len(leaves), pairs))


def _levels(leaves: int, pairs: list[tuple[int, int]]) -> list[np.ndarray]:
    """Inner nodes by depth, each as (node, part, part), so that a level is made at once."""
    depth = [0] * leaves
    for a, b in pairs:
        depth.append(1 + max(depth[a], depth[b]))
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for i, (a, b) in enumerate(pairs):
        rows.setdefault(depth[leaves + i], []).append((leaves + i, a, b))
    return [np.array(rows[d]).T for d in sorted(rows)]


def _compiled(rows: pd.DataFrame) -> pd.DataFrame:
    items = {int(i): dict(zip(g["term"], g["times"].astype(int), strict=True)) for i, g in rows.groupby("item")}
    return pd.DataFrame({"block": rows["block"].iloc[:1], "program": [pickle.dumps(compile_block(items))]})


class Vocabulary:
    """Terms by the 64-bit codes of their bytes."""

    def __init__(self, names: list[str]):
        codes = np.concatenate([Words(d, o, outside=OUTSIDE).code for _, _, d, o in slices(pa.array(names, pa.string()))]) if names else np.zeros(0, dtype=np.uint64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the terms that are known, in the order of rows."""
        row = np.repeat(np.arange(words.rows), np.diff(words.first))
        at = np.minimum(np.searchsorted(self.codes, words.code), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == words.code if len(self.codes) else np.zeros(len(at), dtype=bool)
        key, n = np.unique(row[hit] * len(self.codes) + self.order[at[hit]], return_counts=True)
        return key // max(len(self.codes), 1), key % max(len(self.codes), 1), n


def _statistics(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents with terms (key -2), terms (-1), and documents by known term."""
    docs = length = 0
    df = np.zeros(len(vocabulary.codes), dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.columns[0]):
            words = Words(data, offsets, outside=OUTSIDE)
            n = np.diff(words.first)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(vocabulary.counts(words)[1], minlength=len(df))
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[docs, length], df[seen]]))], names=["key", "n"])


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def length_norm(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """25 + (75 n docs) div length, exact where the product is beyond 64 bits too."""
    if len(n) and int(n.max()) * 75 * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // max(length, 1) for x in n], dtype=np.int64)
    return 25 + 75 * n.astype(np.int64) * docs // max(length, 1)


def _scores(program: Program, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, leaf: tuple) -> np.ndarray:
    """(items, documents) of a batch: leaves from the contributions, then level by level, then the items."""
    leaf_of, leaf_first, times = leaf
    part = np.zeros((len(program.leaves) + len(program.pairs), rows), dtype=np.int64)
    n = leaf_first[term + 1] - leaf_first[term]  # a term is as many leaves as it has different repeats
    at = np.arange(n.sum()) + np.repeat(leaf_first[term] - np.cumsum(n) + n, n)
    where = leaf_of[at]
    part[where, np.repeat(row, n)] = np.repeat(value, n) * times[where]
    for node, a, b in program.levels:
        part[node] = part[a] + part[b]
    size = np.array([len(r) for r in program.rests])
    whole = np.concatenate([np.asarray(r, dtype=np.int64) for r in program.rests])
    return np.add.reduceat(part[whole], np.cumsum(size) - size, axis=0)


NO_ID = np.iinfo(np.int64).max


class Best:
    """The ``k`` best (score, document) of each item; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), dtype=np.int64)
        self.id = np.full((items, k), NO_ID)
        self.none = np.ones((items, k), dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        items = np.flatnonzero((scores.max(1) >= self.score[:, -1]) & (scores.max(1) > 0))
        if not len(items):
            return
        order = np.lexsort((ids, none))
        scores = scores[np.ix_(items, order)]
        top = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        score = np.concatenate([self.score[items], np.take_along_axis(scores, top, 1)], 1)
        at = order[top]
        id_, no = np.concatenate([self.id[items], ids[at]], 1), np.concatenate([self.none[items], none[at]], 1)
        best = np.lexsort((id_, no, -score), axis=1)[:, : self.k]
        self.score[items], self.id[items], self.none[items] = (np.take_along_axis(x, best, 1) for x in (score, id_, no))


def _ranked(program: Program, df: np.ndarray, docs: int, length: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary, weight = Vocabulary(program.terms), weights(df, docs)
    of = np.array([t for t, _ in program.leaves])
    leaf_of = np.argsort(of, kind="stable")
    leaf = (leaf_of, np.searchsorted(of[leaf_of], np.arange(len(program.terms) + 1)), np.array([n for _, n in program.leaves]))
    step = max(1, CELLS // (len(program.leaves) + len(program.pairs)))
    best = Best(len(program.items), k)
    for batch in batches:
        none = pc.is_null(batch.columns[0]).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.columns[0], NO_ID).to_numpy()
        for lo, hi, data, offsets in slices(batch.columns[1]):
            words = Words(data, offsets, outside=OUTSIDE)
            norm = length_norm(np.diff(words.first), docs, length)
            row, term, tf = vocabulary.counts(words)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[row]))
            for a in range(0, hi - lo, step):
                b = min(a + step, hi - lo)
                x, y = np.searchsorted(row, (a, b))
                best.add(_scores(program, row[x:y] - a, term[x:y], value[x:y], b - a, leaf), ids[lo + a : lo + b], none[lo + a : lo + b])
    item, place = np.nonzero(best.score)
    found = pa.array(best.id[item, place], mask=best.none[item, place])
    yield pa.RecordBatch.from_arrays([pa.array(np.array(program.items, dtype=np.int64)[item]), found, pa.array(best.score[item, place])], names=["item", "doc_id", "score"])


def in_blocks(queries: DataFrame, item: str, text: str, block_terms: int) -> DataFrame:
    """A written table of the items that have terms: ``_item`` (a number of the row's own), ``item_id``, ``bag``, ``block``."""
    bag = F.transform(F.array_distinct("_terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("_terms", lambda x: x == t)).alias("times")))
    rows = queries.select(F.col(item).alias("item_id"), terms(text).alias("_terms")).where(F.size("_terms") > 0)
    rows = written(rows.select(F.monotonically_increasing_id().alias("_item"), "item_id", bag.alias("bag")), "items").withColumn("_part", F.shiftright("_item", 33))
    size = F.size("bag").cast("long")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = rows.groupBy("_part").agg(F.sum(size).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    running = F.sum(size).over(Window.partitionBy("_part").orderBy("_item")) + F.col("_base")
    return written(rows.join(F.broadcast(parts), "_part").withColumn("block", F.floor((running - 1) / block_terms)).drop("_part", "_base"), "item-blocks")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 of each item.

    The weight of a term is floor(1000 ln((2N + 2) / (2 df + 1))) over all documents with a term; all else is integer. Equal
    scores go by ascending document id (an integer; null ids last). Terms are matched by 64-bit codes. Every row is a document
    and every row of ``queries`` an item, whatever their ids: repeated items have repeated results. Null and empty texts
    have no terms, match nothing and have no result; texts of any length are read whole; other columns are not read. Empty
    tables give an empty result. The driver holds one block's program at a time; documents are read twice a block.
    """
    spark = docs.sparkSession
    items = in_blocks(queries, item, text, block_terms)
    bags = items.select("block", F.col("_item").alias("item"), F.inline("bag"))
    programs = written(bags.groupBy("block").applyInPandas(_compiled, "block long, program binary"), "programs")
    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for (block,) in programs.select("block").orderBy("block").collect():
        program: Program = pickle.loads(programs.where(F.col("block") == block).first()["program"])
        counts = narrow.select("text").mapInArrow(partial(_statistics, Vocabulary(program.terms)), "key long, n long")
        total = {r["key"]: r["n"] for r in counts.groupBy("key").agg(F.sum("n").alias("n")).collect()}
        df = np.array([total.get(i, 0) for i in range(len(program.terms))])
        best = narrow.mapInArrow(partial(_ranked, program, df, total.get(-2, 0), total.get(-1, 0), k), "item long, doc_id long, score long")
        found = found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select(F.col("_item").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")

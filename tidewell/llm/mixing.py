"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Copies that are certain (the whole part of target / size) are given to all of its
documents. The words that remain are a sample of unequal inclusion probabilities: a document's is in proportion to its
size, p = c * size, with c such that the expected words are those that remain; documents for which that reaches 1 are
taken for certain. (So few documents are repeated for the words that are needed.) Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order as long as they fit; what the first that does not fit leaves open is
filled by the next ones in the same order that do fit (twice), and at last by the one document whose size comes nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_names, hot_join, numbered, numbered_among_equals, written

#: Fixed values of the mix: weights by rank of source, share of all words, most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
#: Rank keys fall into this many bins a source, so that the cut is found from sums and not from a sorted source.
BINS = 1 << 12
#: Bins of sizes a doubling, for the constant of the inclusion probabilities.
SIZE_BINS = 16


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> the same with ``target``: weights share out the words, none above its cap.

    The excess is handed on by weight until none is above its cap: each round is one sum over the sources, and ends with the
    level (words a weight) of all that are below their cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    known = numbered(sizes, "mix-sources", F.asc_nulls_last("source")).withColumn("_w", F.element_at(cycle, (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int")))
    known = written(known.withColumn("_cap", cap * F.col("source_size")).drop("_nth"), "mix-weights")
    total = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("_cap") <= level * F.col("_w")
        n, held, weight = known.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if n == full or not weight:
            break
        full, level = n, (total - (held or 0)) / weight
    target = F.least(F.col("_cap").cast("double"), level * F.col("_w")) if weight else F.col("_cap").cast("double")
    return known.select("source", "source_size", target.alias("target"))


def _chances(base: DataFrame, goals: DataFrame) -> DataFrame:
    """(_s, _c): the constant of each source, so that the sum of size * min(1, c * size) is what remains.

    Sizes are summed in bins (at most 64 * ``SIZE_BINS`` a source); from the largest bin down, bins are certain until the rest's
    constant gives none of them a chance above 1.
    """
    bins = base.where("size > 0").groupBy("_s", F.floor(F.log2("size") * SIZE_BINS).alias("_b")).agg(
        F.sum("size").alias("_one"), F.sum(F.col("size").cast("double") * F.col("size")).alias("_two"), F.max("size").alias("_most")
    )
    bins = bins.join(goals.where("_rest > 0").select("_s", "_rest"), "_s")
    above = Window.partitionBy("_s").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    c = (F.col("_rest") - F.coalesce(F.sum("_one").over(above), F.lit(0))) / F.sum("_two").over(below)
    fits = bins.select("_s", "_b", c.alias("_c"), "_most").withColumn("_fits", F.col("_c") * F.col("_most") <= 1)
    best = F.coalesce(F.max(F.when(F.col("_fits"), F.struct("_b", "_c"))), F.min(F.struct("_b", "_c")))
    return fits.where("_c > 0").groupBy("_s").agg(best["_c"].alias("_c"))


def _cut(live: DataFrame, total: int) -> DataFrame:
    """(_s, _edge, _took): of each source the first document in rank order that does not fit any more, and the words before it."""
    bins = live.groupBy("_s", "_bin").agg(F.sum("size").alias("_words"), F.first("_need").alias("_need"), F.first("_docs").alias("_docs"))
    upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    crossed = F.min(F.when(F.col("_before") + F.col("_words") > F.col("_need"), F.struct("_bin", "_before")))
    cut = written(bins.groupBy("_s").agg(crossed.alias("x"), F.sum("_words").alias("_all"), F.first("_docs").alias("_docs")), "mix-cut-bins")
    open_ = cut.where("x is not null").select("_s", "_docs", F.col("x._bin").alias("_at"), F.col("x._before").alias("_before"))
    here = hot_join(live.drop("_docs"), open_, "_s", "_docs", total).where("_bin = _at")
    within = Window.partitionBy("_s").orderBy("_rank", "_row").rowsBetween(Window.unboundedPreceding, 0)
    here = here.withColumn("_sum", F.col("_before") + F.sum("size").over(within))
    edge = here.where("_sum > _need").groupBy("_s").agg(F.min(F.struct(F.col("_rank"), F.col("_row"), (F.col("_sum") - F.col("size")).alias("took"))).alias("e"))
    everything = F.struct(F.lit(float("inf")).alias("_rank"), F.lit(0).cast("long").alias("_row"), F.col("_all").alias("took"))
    both = cut.join(edge, "_s", "left").withColumn("e", F.coalesce("e", everything))
    return both.select("_s", F.struct("e._rank", "e._row").alias("_edge"), F.col("e.took").alias("_took"))


def pareto_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, weights=WEIGHTS,
    share: float = SHARE, cap: int = MAX_COPIES, row: str | None = None,
) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, taken, and the column ``row`` if one is named.

    ``copies`` is 0 to ``cap`` and ``taken`` is copies * size. Reruns agree: the random number is a hash of key, text and
    the row's number among equal ones.
    Null texts and texts without words have size 0 and no copies beyond the certain ones; a null source is a source,
    ordered last; null and repeated keys are documents of their own; of equal rows, which one is taken is left open; a very
    long text that does not fit is passed over; an empty table gives an empty result; other columns are not read.
    A source that holds a third of all rows is summed by bins of the rank before the cut; only the documents of
    the one bin that holds the cut are sorted.
    """
    own = [F.col(row).alias("_own")] if row else []
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    base = written(
        docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(text).alias("size"), mark.alias("_order"), *own).withColumn("_row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    total = base.count()
    equal = written(base.groupBy("_order").agg(F.count("*").alias("n")).where("n > 1").select("_order"), "mix-equal-rows")
    base = written(numbered_among_equals(base, equal), "mix-numbered", base)  # each of equal rows has a draw of its own
    base = base.withColumns({"_u": (F.shiftrightunsigned(F.xxhash64("_order", "_nth"), 11).cast("double") + 0.5) / float(1 << 53), "_s": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))})
    sizes = base.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    goals = source_targets(sizes.select("source", "source_size"), weights, share, cap).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    whole = F.coalesce(F.least(F.lit(cap), F.floor(F.try_divide("target", "source_size") + 1e-9)), F.lit(0)).cast("int")
    goals = goals.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    goals = written(goals.join(sizes.select("_s", "_docs"), "_s"), "mix-goals")
    goals = written(goals.join(_chances(base, goals), "_s", "left").drop("source"), "mix-targets")
    p = F.least(F.lit(1.0), F.col("_c") * F.col("size"))
    rank = F.when(p >= 1, 0.0).otherwise(F.try_divide(F.col("_u") / (1 - F.col("_u")), p / (1 - p)))
    ranked = hot_join(base.drop("source"), goals, "_s", "_docs", total).withColumn("_rank", F.when(F.col("_rest") > 0, rank))
    # rank / (1 + rank) keeps the order of the rank and lies between 0 and 1
    ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS).cast("int"))
    ranked = written(ranked.drop("_u", "_order", "_nth", "_c"), "mix-ranked")
    drawn = ranked.where("_rank is not null and size > 0").select("_s", "_row", "size", "_rank", "_bin")

    edges = F.array().cast("array<struct<most:double,rank:double,row:bigint>>")
    state = goals.where("_rest > 0").select("_s", "_docs", F.col("_rest").alias("_need"), edges.alias("_edges"))
    is_taken = F.exists("_edges", lambda e: (F.col("size") <= e["most"]) & ((F.col("_rank") < e["rank"]) | ((F.col("_rank") == e["rank"]) & (F.col("_row") < e["row"]))))
    for most in (F.lit(float("inf")), F.col("_need"), F.col("_need")):
        asked = state.withColumn("_most", most)
        live = hot_join(drawn, asked, "_s", "_docs", total).where((F.col("size") <= F.col("_most")) & ~is_taken)
        both = asked.join(_cut(live, total), "_s", "left")
        edge = F.array(F.struct(F.col("_most").alias("most"), F.col("_edge._rank").alias("rank"), F.col("_edge._row").alias("row")))
        grown = F.when(F.col("_edge").isNull(), F.col("_edges")).otherwise(F.concat("_edges", edge))
        state = written(both.select("_s", "_docs", (F.col("_need") - F.coalesce("_took", F.lit(0))).alias("_need"), grown.alias("_edges")), "mix-edges")
    live = hot_join(drawn, state, "_s", "_docs", total).where(~is_taken).withColumn("_off", F.abs(F.col("size") - F.col("_need")))
    last = live.where("_off < _need").groupBy("_s").agg(F.min(F.struct("_off", "_rank", "_row"))["_row"].alias("_last"))
    state = written(state.drop("_need").join(last, "_s", "left"), "mix-edges")
    final = hot_join(ranked.drop("_docs"), goals.select("_s", "_docs").join(state.drop("_docs"), "_s", "left"), "_s", "_docs", total)
    extra = (F.col("_rank").isNotNull() & (F.col("size") > 0)) & (F.coalesce(is_taken, F.lit(False)) | F.coalesce(F.col("_row") == F.col("_last"), F.lit(False)))
    copies = F.least(F.lit(cap), F.col("_whole") + F.when(extra, 1).otherwise(0))
    return final.select(
        F.col("_key").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *([F.col("_own").alias(row)] if row else [])
    )


def repeat_mix(docs: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of a mix, each as many times as it is taken, with the columns of ``docs`` whatever their names.

    ``key`` tells rows apart and is not null: where ids are null or repeated, it is the ``row`` of :func:`pareto_mix`.
    """
    n, copy = free_names(docs.columns, "copies", "copy")
    copies = mix.where("copies > 0").select(key, F.col("copies").alias(n))
    return docs.join(copies, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy)).drop(copy)

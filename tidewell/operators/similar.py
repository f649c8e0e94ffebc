"""Near matches without all pairs: a similarity join of titles, and descriptions compared only where titles are near.

Two titles with a ratio of at least ``t`` differ by at most d = (100 - t) / 100 * (length of both) characters put in or left
out. The longer of the two (of one length, the greater) is cut into one piece more than it may differ by from any that is not longer, so a piece stays
whole; and there is one, the i-th, before which exactly i characters differ: it stands in the shorter title at most i places
off, and as far off as i is odd or even (a count of changes, less one a piece, ends below 0, and where it is 0 for the last time a
piece is whole). So titles meet by whole pieces at their places, lengths and companies. A pair goes on if the counts of its
characters differ by no more than d, told by sets of bits ("count filter"); only then the ratio is taken. No filter loses a pair.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import fixed
from tidewell.functions.geo import locations_match
from tidewell.functions.similarity import indel_ratio, links_of_blocks, token_set_ratio
from tidewell.functions.text import let
from tidewell.tables import written

#: Least length of a piece of a title that may be near another.
Q = 3


def _apart(both: Column | int, least: float) -> Column | int:
    """Most characters that two titles of so many characters together may differ by."""
    most = (100.0 - least) * both / 100.0 + 1e-9
    return int(most) if isinstance(both, int) else F.floor(most).cast("int")


def lossless(least: float) -> bool:
    """Whether pieces of near titles of any length have at least ``Q`` characters at this ratio; 92 is enough, 90 is not."""
    return all(n // (_apart(2 * n, least) + 1) >= Q for n in range(1, 1000) if _apart(2 * n, least))


def _marks(title: str) -> Column:
    """64 bits, one turned for each character and how often it came before: titles that differ by d characters differ by at most d bits."""
    chars = F.sort_array(F.split(F.col(title), ""))
    turned = lambda cs: F.transform(cs, lambda c, i: F.pmod(F.xxhash64(c, i - F.array_position(cs, c)), F.lit(64)).cast("int"))
    return F.aggregate(let(chars, turned), F.lit(0).cast("long"), lambda acc, n: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), n)))


def _pieces(size: Column, i: Column, most: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of ``most`` + 1 pieces of a title of ``size`` characters."""
    start = F.floor(i * size / (most + 1)).cast("int")
    return start, F.floor((i + 1) * size / (most + 1)).cast("int") - start


def title_candidates(titles: DataFrame, least: float = fixed.TITLE_THRESHOLD) -> DataFrame:
    """(company_key, a_title, b_title) of different titles of one company that may be near; ``titles``: company_key, title_key, a, b.

    ``a`` and ``b`` say on which side of the join a title stands; a title is a row. A title has as many rows as pieces and, as
    the shorter one, a row a length and place where a piece may stand: about 60 for a title of 40 characters, of which those that no
    piece meets end in the join. A ratio at which pieces would be shorter than ``Q`` is refused.
    """
    if not lossless(least):
        raise ValueError(f"pieces of titles with a ratio of {least} are shorter than {Q}")
    c = F.col
    t = titles.where("company_key is not null and title_key is not null").withColumn("_len", F.length("title_key")).where("_len > 0")
    t = written(t.select("company_key", "title_key", "a", "b", "_len", _marks("title_key").alias("_bits")), "title-marks")
    most = _apart(2 * c("_len"), least)
    long = t.withColumn("_most", most).where("_most > 0").select("*", F.explode(F.sequence(F.lit(0), c("_most"))).alias("_i"))
    start, size = _pieces(c("_len"), c("_i"), c("_most"))
    long = long.select("company_key", c("_len").alias("_for"), "_i", F.substr("title_key", start + 1, size).alias("_piece"), c("title_key").alias("x"), c("a").alias("xa"), c("b").alias("xb"), c("_bits").alias("x_bits"))
    lengths = F.broadcast(t.select(c("_len").alias("_for")).distinct())  # at most one row a length
    short = t.join(lengths, (c("_for") >= c("_len")) & (c("_len") * (200.0 - least) >= c("_for") * least - 1e-9))
    short = short.withColumns({"_most": _apart(2 * c("_for"), least), "_d": _apart(c("_for") + c("_len"), least)}).where("_d > 0")
    short = short.withColumn("_i", F.explode(F.sequence(F.lit(0), c("_d"))))  # exactly i changes before the piece, so i is at most d
    short = short.withColumn("_off", F.explode(F.transform(F.sequence(F.lit(0), c("_i")), lambda k: 2 * k - c("_i"))))
    start, size = _pieces(c("_for"), c("_i"), c("_most"))
    at = start + c("_off")
    short = short.where((F.abs(c("_for") - c("_len") + c("_off")) <= c("_d") - c("_i")) & (at >= 0) & (at + size <= c("_len")))
    short = short.select("company_key", "_for", "_i", F.substr("title_key", at + 1, size).alias("_piece"), c("title_key").alias("y"), c("a").alias("ya"), c("b").alias("yb"), c("_bits").alias("y_bits"), "_d", c("_len").alias("_short"))
    met = long.join(short, ["company_key", "_for", "_i", "_piece"])
    met = met.where(((c("_for") > c("_short")) | (c("x") > c("y"))) & ((c("xa") & c("yb")) | (c("xb") & c("ya"))) & (F.bit_count(c("x_bits").bitwiseXOR(c("y_bits"))) <= c("_d")))
    pairs = met.select("company_key", "x", "y", (c("xa") & c("yb")).alias("_there"), (c("xb") & c("ya")).alias("_back")).distinct()
    ends = lambda u, v: F.struct(c(u).alias("a_title"), c(v).alias("b_title"))
    both = F.filter(F.array(F.when(c("_there"), ends("x", "y")), F.when(c("_back"), ends("y", "x"))), lambda e: e.isNotNull())
    return pairs.select("company_key", F.inline(both))


def near_titles(titles: DataFrame, least: float = fixed.TITLE_THRESHOLD) -> DataFrame:
    """(company_key, a_title, b_title) of titles of one company, the same or with a ratio of at least ``least``."""
    near = title_candidates(titles, least).where(indel_ratio("a_title", "b_title") >= least).select("company_key", "a_title", "b_title")
    same = titles.where("a and b and company_key is not null and title_key is not null")
    return near.unionByName(same.select("company_key", F.col("title_key").alias("a_title"), F.col("title_key").alias("b_title")))


CLASS = ("company_key", "title_key", "location_key", "text_key")


def class_key() -> Column:
    """What postings have in common that match alike; null for one that matches none by likeness."""
    known = F.coalesce(F.col("text_key") != "", F.lit(False))
    for c in CLASS[:3]:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.sha2(F.concat_ws("\x1f", *CLASS), 256))


def classes(rows: DataFrame, id_: str) -> DataFrame:
    """(class_key, keys, least): postings that match alike, once, with the least id."""
    keyed = rows.withColumn("class_key", class_key()).where("class_key is not null")
    return keyed.groupBy("class_key").agg(*[F.first(c).alias(c) for c in CLASS], F.min(id_).alias("least"))


def place_blocks() -> Column:
    """The whole place and its naming words: places that match share one of these."""
    generic = F.array(*[F.lit(t) for t in fixed.GENERIC_LOCATION_TOKENS])
    tokens = F.array_except(F.filter(F.split("location_key", " "), lambda t: t != ""), generic)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.col("location_key"))), tokens))


def may_be_near(a: str, b: str, least: float) -> Column:
    """Whether the ratio of two sets of words can reach ``least``, by the lengths of what they share and what they do not."""
    x, y = F.split(a, " "), F.split(b, " ")
    size = lambda words: F.length(F.array_join(words, " "))
    both, la, lb = size(F.array_intersect(x, y)), size(F.array_except(x, y)), size(F.array_except(y, x))
    core = both + F.when(both > 0, 1).otherwise(0)
    long = (core + F.least(la, lb)) * 200.0 >= (2 * core + la + lb) * least - 1e-9
    short = (both > 0) & (both * 200.0 >= (both + core + F.least(la, lb)) * least - 1e-9)
    return long | short | ((both > 0) & ((la == 0) | (lb == 0)))


def near_classes(left: DataFrame, right: DataFrame, title_threshold: float = fixed.TITLE_THRESHOLD, text_threshold: float = fixed.DESCRIPTION_THRESHOLD) -> DataFrame:
    """(a_class, a_least, b_class, b_least): classes (``classes``) of one company with near titles, matching places and near texts.

    Titles are joined first, each once a company; then postings meet by (company, title that is near, block of the place).
    """
    flagged = lambda rows, a, b: rows.select("company_key", "title_key", F.lit(a).alias("a"), F.lit(b).alias("b"))
    titles = flagged(left, True, False).unionByName(flagged(right, False, True)).groupBy("company_key", "title_key").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    pairs = written(near_titles(written(titles, "titles"), title_threshold), "near-titles")
    side = lambda rows, s: rows.select("company_key", F.col("title_key").alias(f"{s}_title"), F.col("location_key").alias(f"{s}_loc"), F.col("text_key").alias(f"{s}_text"), F.col("class_key").alias(f"{s}_class"), F.col("least").alias(f"{s}_least"), place_blocks().alias(f"{s}_blocks"))
    a = side(left, "a").join(pairs, ["company_key", "a_title"]).withColumn("block", F.explode("a_blocks"))
    b = side(right, "b").withColumn("block", F.explode("b_blocks"))
    met = a.join(b, ["company_key", "b_title", "block"]).where(F.get(F.array_intersect("a_blocks", "b_blocks"), 0) == F.col("block"))
    met = met.where(locations_match("a_loc", "b_loc", normalized=True) & ((F.col("a_text") == F.col("b_text")) | may_be_near("a_text", "b_text", text_threshold)))
    near = met.where(token_set_ratio("a_text", "b_text") >= text_threshold)
    return near.select("a_class", "a_least", "b_class", "b_least")


#: What classes of one cell have in common, and how many of them, about, are compared at once with as many others.
CELL, BLOCK = ("company_key", "title_key", "location_key"), 48


def near_links(rows: DataFrame, title_threshold: float = fixed.TITLE_THRESHOLD, text_threshold: float = fixed.DESCRIPTION_THRESHOLD) -> DataFrame:
    """(u, v): links among the groups of classes (``classes``, and a long ``group``) that are near as in ``near_classes``.

    What hangs together by these links is what hangs together by all near pairs: a pair within one group is left out, and two blocks of
    classes put out a forest of links. Cells meet first, by near title and place; only where they hold more than one group their
    classes are dealt into blocks by a hash. Of two large cells of a group each, every block meets the other's shortest text first; if
    that links them, it is all there is to know. Of the others every block meets every block, once.
    """
    c = F.col
    titles = rows.select("company_key", "title_key", F.lit(True).alias("a"), F.lit(True).alias("b")).distinct()
    pairs = written(near_titles(written(titles, "titles"), title_threshold), "near-titles")
    ends = (F.min("group").alias("lo"), F.max("group").alias("hi"))
    short = F.min(F.struct(F.length("text_key").alias("size"), "group", "text_key"))
    cells = rows.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), short.alias("short"), *ends)
    cells = written(cells.withColumn("blocks", place_blocks()), "cells")

    def named(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select("company_key", c("title_key").alias(f"{s}_title"), c("location_key").alias(f"{s}_loc"), *[c(x).alias(f"{s}_{x}") for x in more])

    ids = {s: ["company_key", f"{s}_title", f"{s}_loc"] for s in "ab"}
    one = (c("a_lo") == c("a_hi")) & (c("b_lo") == c("b_hi"))
    several = ~(one & (c("a_lo") == c("b_lo")))
    a = named(cells, "a", "lo", "hi", "parts", "blocks").join(pairs, ["company_key", "a_title"]).withColumn("block", F.explode("a_blocks"))
    b = named(cells, "b", "lo", "hi", "parts", "blocks").withColumn("block", F.explode("b_blocks"))
    met = a.join(b, ["company_key", "b_title", "block"]).where(several & (F.struct("a_title", "a_loc") <= F.struct("b_title", "b_loc")))
    met = met.where((F.get(F.array_intersect("a_blocks", "b_blocks"), 0) == c("block")) & locations_match("a_loc", "b_loc", normalized=True))
    large = one & (c("a_parts") * c("b_parts") > 1)
    met = met.select("company_key", "a_title", "a_loc", "b_title", "b_loc", large.alias("large"), F.greatest("a_lo", "b_lo").alias("u"), F.least("a_lo", "b_lo").alias("v"))
    met = written(met, "cells-met")

    at = [met.select(*[c(x).alias(y) for x, y in zip(ids[s], CELL)]) for s in "ab"]
    dealt = rows.join(cells.select(*CELL, "parts").join(at[0].union(at[1]).distinct(), list(CELL)), list(CELL)).withColumn("part", F.pmod(F.xxhash64("class_key"), c("parts")))
    blocks = written(dealt.groupBy(*CELL, "part").agg(F.collect_list(F.struct("group", "text_key")).alias("items"), *ends), "blocks")
    linked = lambda both: both.select("a", "b").mapInArrow(partial(links_of_blocks, least=text_threshold), "u long, v long")
    shortest = cells.withColumn("x", F.array(F.struct("short.group", "short.text_key")))
    sides = [met.where("large").join(named(blocks, s, "items"), ids[s]).join(named(shortest, o, "x"), ids[o]).select(c(f"{s}_items").alias("a"), c(f"{o}_x").alias("b")) for s, o in ("ab", "ba")]
    first = written(linked(sides[0].union(sides[1])).distinct(), "links")

    open_ = met.join(first.withColumn("large", F.lit(True)), ["large", "u", "v"], "left_anti").drop("large", "u", "v")
    heads = open_.join(named(blocks, "a", "part", "lo", "hi"), ids["a"]).join(named(blocks, "b", "part", "lo", "hi"), ids["b"])
    same = (c("a_title") == c("b_title")) & (c("a_loc") == c("b_loc"))
    heads = heads.where(several & (~same | (c("a_part") <= c("b_part")))).drop("a_lo", "a_hi", "b_lo", "b_hi")
    texts = lambda s: named(blocks, s, "part", "items").withColumnRenamed(f"{s}_items", s)
    return first.union(linked(heads.join(texts("a"), [*ids["a"], "a_part"]).join(texts("b"), [*ids["b"], "b_part"])))

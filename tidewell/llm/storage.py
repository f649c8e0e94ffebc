"""Where the operators of this subpackage keep intermediate tables, names that clash with no column, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.tables import shared_dir, shuffles_dropped, table, written

__all__ = ["counted", "free_names", "hot_join", "numbered", "numbered_among_equals", "row_hash", "salted_join", "shared_dir", "shuffles_dropped", "table", "written"]

#: Keys that hold more than one row in so many are hot; there are at most so many of them.
HOT_KEYS = 4096


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores at its end until no column (Spark tells no case apart) is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, merge: bool = False) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key, ``count`` of them the key's number of rows in ``rows``).

    A key with more than ``total / HOT_KEYS`` of the rows is hot. There are fewer than ``HOT_KEYS`` hot keys whatever the
    input, so these are listed and their facts broadcast: no hot key is shuffled. All other rows are joined by the key, with
    ``merge`` by a shuffle of both sides where both grow with the input.
    """
    hot = F.col(count) * HOT_KEYS > total
    few = facts.where(hot)
    keys = [r[0] for r in few.select(key).collect()]
    rest = facts.where(~hot).hint("merge") if merge else facts.where(~hot)
    if not keys:
        return rows.join(rest, key)
    listed = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.where(listed).join(F.broadcast(few), key).unionByName(rows.where(~listed).join(rest, key))


def salted_join(rows: DataFrame, facts: DataFrame, on: list[str], counts: DataFrame, spread: Column) -> DataFrame:
    """``rows`` joined with ``facts`` (any number a key) by ``on``, the rows of a hot key dealt over parts by ``spread``.

    ``counts`` holds (``on``, _n), a key's number of rows, all of them or in a sample: it decides where rows go and never which
    rows come out. A key with more than one row in ``HOT_KEYS`` is hot: it gets a part for every so many rows, and its facts are
    copied once a part. There are fewer than ``HOT_KEYS`` hot keys, which are broadcast, and fewer than twice as many parts.
    """
    salts, salt = free_names([*rows.columns, *facts.columns], "_salts", "_salt")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("_n") * HOT_KEYS > total).select(*on, F.ceil(F.col("_n") * HOT_KEYS / total).cast("int").alias(salts)))
    parts = F.coalesce(F.col(salts), F.lit(1))
    left = rows.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(spread), parts).cast("int")).drop(salts)
    right = facts.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(salts)
    return left.join(right, [*on, salt]).drop(salt)


def counted(placed: DataFrame) -> DataFrame:
    """A written table with ``_nth``, 0, 1, ... in the order of its ``_id`` (a ``monotonically_increasing_id``), counted by parts."""
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(parts), "_part").withColumn("_nth", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_base")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` as a written table with ``_nth``, 0, 1, ... in this order: sorted by ranges and counted by parts."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return counted(written(placed, name))


def _hashable(field) -> Column:
    kind = field.dataType.simpleString()
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, maps and variants by their JSON."""
    return F.xxhash64(*[_hashable(f) for f in df.schema.fields])


def numbered_among_equals(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``: 0, 1, ... among the rows of each ``_order`` of ``heavy``, 0 for others; counted by parts of the table."""
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "equal-rows")
    mine = rows.select("_order", "_id", F.shiftright("_id", 33).alias("_part")).join(heavy, "_order")
    before = Window.partitionBy("_order").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = mine.groupBy("_order", "_part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_order", "_part").orderBy("_id")) - 1
    nth = mine.withColumn("place", place).join(counts, ["_order", "_part"]).select("_id", (F.col("place") + F.col("before")).alias("_nth"))
    return rows.join(nth, "_id", "left").drop("_id").withColumn("_nth", F.coalesce("_nth", F.lit(0).cast("long")))

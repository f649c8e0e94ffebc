"""Connected components of a link table by star contraction (large-star and small-star by turns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.tables import written


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a batch: each node with the least node it is known to reach, in place of the batch's links."""
    for batch in batches:
        nodes, ends = np.unique(np.concatenate([batch[0].to_numpy(), batch[1].to_numpy()]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        half = len(ends) // 2
        for a, b in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        roots = np.array([find(i) for i in range(len(nodes))], dtype=np.int64)
        kept = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(nodes[roots[kept]])], names=["u", "v"])


def connected_components(links: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each linked node reaches. Nodes without links have no row.

    Self-links and nulls are dropped, repeated links count once. A hub's links are only ever summed up (a minimum) and
    joined by its key, never gathered; the number of rounds grows with the logarithm of the longest path.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = written(links.mapInArrow(_local_forest, "u long, v long").distinct(), "stars")
    seen = None
    for _ in range(max_rounds):
        for keep_larger in (True, False):
            both = stars.select("u", "v")
            if keep_larger:
                both = both.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            joined = both.join(least, "u")
            if keep_larger:  # each larger neighbour points to the least node around
                stars = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            else:  # each smaller neighbour, and the node itself, points to the least
                stars = (
                    joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
                )
        stars = written(stars, "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(known: DataFrame, links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): the rows of a component table that new links add or change; all others stay as they are.

    ``known`` (node, component) names each node's component by its least node. A link joins two components, so only these
    are contracted: a graph of the components that the batch touches, whatever they hold. Of a component that gets another name
    every node is written again; one that keeps its name costs nothing but its new nodes. Self-links make a node known.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = written(ends.join(known.select("node", F.col("component").alias("was")), "node", "left").withColumn("name", F.coalesce("was", "node")), "touched")
    named = lambda end: now.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
    between = links.join(named("u"), "u").join(named("v"), "v").select(F.col("u_name").alias("u"), F.col("v_name").alias("v"))
    joined = written(connected_components(between).where("node <> component").select(F.col("node").alias("name"), "component"), "renamed")
    new = now.where("was is null").join(joined, "name", "left").select("node", F.coalesce("component", "name").alias("component"))
    moved = known.select("node", F.col("component").alias("name")).join(joined, "name").select("node", "component")
    return new.unionByName(moved)


def latest_components(log: DataFrame) -> DataFrame:
    """(node, component) from a log of ``merged_components`` with a column ``batch``: the newest row of each node."""
    return log.groupBy("node").agg(F.max_by("component", "batch").alias("component"))

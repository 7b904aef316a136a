"""Connected components of an undirected graph by alternating star contractions.

Large-star hooks every larger neighbour of a node to the node's smallest
neighbour, small-star does the same with the smaller ones; after a number of
rounds that grows with the logarithm of the node count every component is one
star around its smallest node.  Each round is two group-and-join steps whose
exchanges Spark can split at hot nodes, and its edges are written to the shared
folder, so neither lineage nor driver memory grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) \
        .unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")) \
        .select("c", F.least("c", "m").alias("m"))
    if large:
        far = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("c"))
        out = far.select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        near = both.filter(F.col("v") < F.col("u")).join(least, F.col("u") == F.col("c"))
        out = near.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(r)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the component's smallest node.

    Self links, repeated and reversed links are allowed; nulls are not.  An
    empty graph gives an empty result.
    """
    now = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .filter(F.col("a") != F.col("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        after = stash(_star(_star(now, large=True), large=False), "links")
        drop_stash(now)
        last, now, mark = mark, after, _mark(after)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")) \
        .unionByName(roots.select(F.col("root").alias("node"), "root"))

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmend.llm.common import written

#: Rounds after which it gives up; paths of n nodes need about log2(n) of them.
MAX_ROUNDS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b. large: every larger neighbour of a node is hung on the node's smallest
    neighbour (or itself). small: every smaller neighbour, and the node, is hung on the smallest of them.

    The smallest neighbour is an aggregate, so a node with very many edges costs one row per task; the join that hangs
    the others is split by the adaptive skew join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    if large:
        hung = edges.join(least, edges["b"] == least["node"]).select(edges["a"], F.col("root").alias("b"))
    else:
        own = least.select(F.col("node").alias("a"), F.col("root").alias("b"))
        hung = edges.join(least, edges["a"] == least["node"]).select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(own)
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b): label is the smallest node of its component.

    Direction, repeats and loops of edges don't matter; rows with a null end are no edges. Every round's edges are
    written to the shared folder, so lineage stays short. A node that is in no edge has no row.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = written(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        if now.isEmpty():
            break
        now = written(star(star(now, True), False), "stars")
        # Done when every node hangs on one root and no root hangs on anything: one row each, and the same rows as before.
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)

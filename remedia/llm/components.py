"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, distinct."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are linked to the least of them."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: whole numbers, any order, repeats allowed) to (node, component), component the least node.

    Nodes without an edge to another node have no row. Each round is written to the shared folder, so lineage
    stays short; neighbours of a hub are reduced by partial aggregation before they meet and its join is one that
    adaptive execution splits. Ends when a round changes nothing.
    """
    now, state = written(_star(edges), "component-edges"), None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        after = written(_star(_small(_star(_large(now)))), "component-edges")
        drop_written(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Settled: every node points at the least of its component, which points nowhere.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

"""Connected components of an edge table by alternating star contractions, each round written to the shared folder.

Large-star links every larger neighbour of a vertex to the smallest vertex it knows, small-star does so with the
smaller neighbours; both are one grouped minimum and one join. The rounds end when no edge changes, after a number of
rounds that grows with the logarithm of the longest path. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """`edges` has a > b; each vertex links its larger (or smaller) neighbours to the smallest vertex in reach."""
    if large:
        around = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    else:
        around = edges.select(F.col("a").alias("v"), F.col("b").alias("n"))
    least = around.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
    linked = around.join(least, "v")
    if large:
        linked = linked.where("n > v")
        return linked.select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
    down = linked.where("n != m").select(F.col("n").alias("a"), F.col("m").alias("b"))
    return down.union(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges(a, b) with values of one ordered type -> (vertex, component): every vertex of an edge, and the smallest
    vertex in reach of it. Loops and repeated edges do no harm, nulls are left out, no edges give no rows."""
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = work.write(now, "edges-0")
    mark, k = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark or state[0] == 0:
            break
        mark, k = state, k + 1
        now = work.write(_star(_star(now, True), False), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
    # every edge now leads from a vertex to its component's smallest one
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())

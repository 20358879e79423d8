"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger neighbours (large) or its smaller ones (small) to its smallest neighbour.

    The smallest neighbour comes from an aggregate with map-side combine that is
    joined back, so a node with any number of neighbours is never gathered.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["node"])
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge. Loops and NULL ends count for nothing.

    Each round ends in a written table, so no lineage grows and a lost executor
    repeats one round at most. The rounds end when the edges no longer change:
    every component is then a star around its smallest node. A logarithmic
    number of rounds is proven; going beyond ``rounds`` is an error, not a cut.
    """
    now = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        now = staged(_star(_star(now, True), False))
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if row == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = row
    raise RuntimeError(f"components not settled after {rounds} rounds")

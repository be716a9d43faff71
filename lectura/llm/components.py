"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round hangs the larger neighbours of every node onto its smallest one (large star), then its smaller ones
    (small star), and writes the edges to the shared folder. It is over when nothing changes, which takes a number of
    rounds near the logarithm of the longest path. Nodes are numbers; an empty list gives no rows. The joins meet nodes with any number of
    neighbours, on rows of two numbers that adaptive execution can split.
    """
    upper = F.greatest("a", "b").alias("a")
    now = stored(edges.where("a <> b").select(upper, F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = hung.union(lowest.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges; equal marks mean that a round changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)

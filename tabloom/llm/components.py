"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, work_table

#: the steps halve distances, so this many would do for paths of 2^60 nodes
MAX_ROUNDS = 60


def _toward_least(edges: DataFrame, n: int) -> DataFrame:
    """(a, b, m): each of the ``n`` edges with the least neighbour of a, or a itself. The minimum is combined before its
    shuffle, and the edges of a node with many neighbours are dealt out, so a hot node is no hot task."""
    per_node = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread_join(edges, per_node, "a", "n", n, ["b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b) between different nodes; root is the least node of its component.

    Null ends and loops are ignored, repeated edges are one. Each round is written to the shared folder, so a lost executor
    costs one round at most; only a count and a hash sum reach the driver."""
    clean = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = work_table(clean, "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours move to the least one
        large = _toward_least(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work_table(large, "large")
        # small star: a node and its smaller neighbours move to the least of them
        star = _toward_least(large, large.count())
        small = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(star.select("a", F.col("m").alias("b")))
        now = work_table(small.where("a != b").distinct(), "small")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

"""Connected components of an edge list, by contraction: nodes move to a neighbour, edges move with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), where root is the least node of the component.

    Each round a node's parent is the first of itself and its neighbours, or that one's parent; first by value in one
    round and by a hash in the next, so that stars and long paths shrink alike. Edges are then replaced by those between the
    parents of their ends, without loops and repetitions, until none is left: some log n rounds. Edges and parents of every
    round go to the shared folder. Joins are on nodes, so a node with very many edges is split by adaptive
    execution. Nothing is collected but a count.
    """
    plain = edges.where("a <> b").select("a", "b")
    both = cut(plain.union(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds: list[DataFrame] = []
    while both.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c) if len(rounds) % 2 else F.lit(0), F.col(c).alias("node"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(rank("a"), "near")["node"].alias("parent"))
        over = least.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        parents = cut(least.join(over, "parent").select("node", F.col("over").alias("parent")))
        rounds.append(parents)
        of_a, of_b = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"over_{c}")) for c in ("a", "b"))
        moved = both.join(of_a, "a").select("over_a", "b").join(of_b, "b").select(F.col("over_a").alias("a"), F.col("over_b").alias("b"))
        both = cut(moved.where("a <> b").distinct())
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop().select("node", F.col("parent").alias("last"))
    while rounds:
        later = found.select(F.col("node").alias("parent"), "last")
        found = rounds.pop().join(later, "parent", "left").select("node", F.coalesce("last", "parent").alias("last"))
    found = cut(found)
    return found.join(found.groupBy("last").agg(F.min("node").alias("root")), "last").select("node", "root")

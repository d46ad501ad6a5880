"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import written

MAX_ROUNDS = 60


def _by_minimum(links: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours of each node that `keep` selects with the node's least neighbour.

    The minimum comes from an aggregate with map-side reduction and is joined back, so a node with very many neighbours
    is never gathered in one task.
    """
    # Written, so that the join has two plain exchanges and a hot node can be split between tasks.
    least = written(links.groupBy("u").agg(F.min("v").alias("least")), "least")
    return (
        links.join(least, "u")
        .select("u", "v", F.least("u", "least").alias("least"))
        .where(keep)
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (least node reachable) for every node with an edge; edges are columns a and b.

    Each round is one large-star and one small-star step, written to the shared folder; the rounds grow with the
    logarithm of the longest path. Loops and repeated edges do no harm, an empty table gives an empty table.
    """
    tree = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(MAX_ROUNDS):
        # u > v always; star steps look at both directions, then at the smaller neighbours only.
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _by_minimum(both, "v > u").where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("least")), "least")
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u <> v")
            .unionByName(least.withColumnRenamed("least", "v"))
            .distinct()
        )
        tree = written(small, "stars")
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)

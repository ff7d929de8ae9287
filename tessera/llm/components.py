"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_table, materialize

#: The number of rounds grows with the logarithm of the longest path; this many hold any real graph.
MAX_ROUNDS = 60
#: Edges that a task of a round writes at least, but for as many tasks as FEW_TASKS: each file costs about as much as so many.
EDGES_A_TASK, FEW_TASKS = 1 << 16, 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the component's least node.

    edges: columns a and b of one orderable type; direction, repeats and loops do not matter, rows with a null are
    left out. Each round is written to the shared folder, so a lost executor costs one round at most. An error is raised
    if MAX_ROUNDS do not suffice.
    """
    greater = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.filter("a <> b").select(*greater).distinct(), "edges")
    sign = None
    for _ in range(MAX_ROUNDS):
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == sign or not n:
            break
        sign = (n, h)
        large = _large_star(now).filter("a <> b").select(*greater).distinct()
        tasks = max(FEW_TASKS, math.ceil(n / EDGES_A_TASK))
        new = materialize(_small_star(large).filter("a <> b").distinct().coalesce(tasks), "edges")
        drop_table(now)
        now = new
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

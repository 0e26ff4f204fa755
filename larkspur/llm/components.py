"""Connected components of an edge table, without ever holding edges in one place.

Alternates large-star and small-star steps: first every node's larger
neighbours, then its smaller ones, are hung on its least neighbour, until the
edges are stars around the least node of each component. Minima are pre-aggregated
before they are shuffled, so a node with very many edges costs no single task.

Each row of the edges becomes one row in each step. Where the edges are few, the
minima are broadcast to them, so that a step shuffles minima only and writes as
few files as it reads; else they meet in a shuffled join, and equal edges become one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_IDS, materialise, small

#: Edges of which the least neighbours are broadcast: of two nodes each.
FEW = BROADCAST_IDS // 2


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))


def _is_star(edges: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has no other one."""
    return _both(edges).groupBy("n").agg(F.min("x").alias("m"), F.max("x").alias("most")).filter("m < n and m < most").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From the first two columns of edges: ``node`` and ``root``, the least node of its component, for every node that is not a root itself. Loops, nulls and repeated edges are ignored."""
    a, b = (F.col(c) for c in edges.columns[:2])
    now = materialise(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    while not _is_star(now):
        few = small(now, FEW)
        of = F.broadcast if few else lambda minima: minima
        once = (lambda rows: rows) if few else DataFrame.distinct
        least = _both(now).groupBy("n").agg(F.min("x").alias("m"))
        large = now.join(of(least), F.col("v") == F.col("n")).select("u", F.least("n", "m").alias("v"))
        large = materialise(once(large), "edges")
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        # the row of a node's least neighbour keeps the node on it, the others hang their neighbour on it
        now = materialise(once(large.join(of(least), F.col("u") == F.col("n")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))), "edges")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))

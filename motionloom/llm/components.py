"""Connected components of an edge table by repeated contraction, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component: the smallest node that can be reached; nodes without edges are absent.

    Each round every node points at its smallest neighbour or itself, pointers are followed twice,
    and edges between what they reach go to the next round. Every round takes away all nodes that have a
    smaller neighbour, so a component that is not a single node loses one node at least (a star with its largest
    node in the middle loses that one, and all others in the second round). The links of a round and the map so far are
    checkpointed, so that a lost executor costs one round at most.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = cut(both(edges.where("a <> b").select("a", "b")))
    found = None
    while True:
        points = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        next_ = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
        points = cut(points.join(next_, "to").select("node", F.col("then").alias("to")))
        if found is None:
            found = points.withColumnRenamed("to", "component")
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            found = cut(
                found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            )
        at_a = points.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        at_b = points.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        links = cut(
            links.join(at_a, "a").join(at_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct()
        )
        if links.isEmpty():
            return found

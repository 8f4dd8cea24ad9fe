"""Connected components of an edge table by contraction, without a driver collect.

Each round every vertex points at the smallest of itself and its neighbours; these
pointers double until each names the root of its chain, so a long path takes a
logarithmic number of steps. Edges are rewritten to the roots, loops and repeats
drop out, and the vertices' labels follow. A component's smallest vertex never
moves, so it is the label left when no edge remains. Every round merges each
vertex that is not a local minimum. Groups reduce to a minimum with a map-side
combine; joins have one row per vertex on one side. Rounds are written tables in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import stored


def rooted(lead: DataFrame) -> DataFrame:
    """``lead(vertex, leader)`` with every leader replaced by the root of its chain."""
    while True:
        up = lead.select(F.col("vertex").alias("leader"), F.col("leader").alias("root"))
        far = stored(lead.join(up, "leader").select("vertex", F.col("root").alias("leader"),
                                                    (F.col("root") < F.col("leader")).alias("moved")), "leaders")
        if not far.filter("moved").head(1):
            return lead
        lead = far.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges(a, b)``: the smallest
    vertex reachable. Loops, repeats and both directions are allowed; an empty
    table gives an empty result."""
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "edges")
    labels = None
    while edges.head(1):
        both = edges.unionAll(edges.select("b", "a"))
        lead = rooted(stored(both.groupBy(F.col("a").alias("vertex"))
                             .agg(F.least(F.min("b"), F.col("vertex")).alias("leader")), "leaders"))
        if labels is None:
            labels = lead.withColumnRenamed("leader", "component")
        else:
            moved = lead.withColumnRenamed("vertex", "component")
            labels = stored(labels.join(moved, "component", "left")
                            .select("vertex", F.coalesce("leader", "component").alias("component")), "labels")
        a = lead.select(F.col("vertex").alias("a"), F.col("leader").alias("la"))
        b = lead.select(F.col("vertex").alias("b"), F.col("leader").alias("lb"))
        edges = stored(edges.join(a, "a").join(b, "b").filter("la <> lb")
                       .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
                       .distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels

"""Connected components of an edge table by alternating large and small stars; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """(of, m): the smallest neighbour of each left end, or itself; partial sums keep a hot node in small pieces."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as of", "least(a, m) as m")


def connected(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the smallest node of the component.  Nodes without an edge are absent."""
    edges, held = edges.where("a != b").selectExpr("greatest(a, b) as a", "least(a, b) as b"), None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        m = _least(both)
        large = both.where("b > a").join(m, both.a == m.of).selectExpr("b as a", "m as b").where("a != b").distinct()
        large = stored(large, "large-star")
        m = _least(large)
        small = large.join(m, large.a == m.of).selectExpr("explode(array(struct(a as a, m as b), struct(b as a, m as b))) as e").select("e.a", "e.b").where("a != b").distinct()
        edges = stored(small, "small-star")
        for x in (large, *([held] if held is not None else [])):
            discard(x)
        held = edges
        # Done when all edges lead from a node to a root: nodes above another one have no edge of their own, others have one.
        ends = edges.selectExpr("inline(array(struct(a as node, 1 as down, 0 as up), struct(b as node, 0 as down, 1 as up)))")
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").take(1):
            break
    roots = edges.selectExpr("a as node", "b as root")
    return roots.unionByName(roots.selectExpr("root as node", "root").distinct())

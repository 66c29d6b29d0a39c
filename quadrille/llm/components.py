"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond") until no edge changes.  Each star is a shuffle of the edge list, and the lineage is cut by writing the
edges into the shared folder.  A hub's neighbours are aggregated to their minimum before the shuffle and dealt over
several tasks to meet it (`skew_join`), never gathered, so a component that holds a third of all nodes
overloads no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark

HUB = 1000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v.  Large: every neighbour above a node links to the least of its neighbourhood; small: those below."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = _spark.skew_join(both, least, ["u"], heavy=HUB)
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each node of edges(a, b) reaches; nodes without an edge are absent.

    Nodes are numbers or any other type with an order.  Null ends, self-links and repeated links are ignored; no links
    give an empty result."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and a is not null and b is not null").distinct()
    e = _spark.materialise(e, "cc")
    tally = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = tally(e)
    for _ in range(max_rounds if before[0] else 0):
        wide = _spark.materialise(_star(e, True), "cc")
        old, e = e, _spark.materialise(_star(wide, False), "cc")
        _spark.discard(old, wide)
        now = tally(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not converge")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))

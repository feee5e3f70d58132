"""Connected components by alternating large-star and small-star steps.

Each round maps every edge set to one with the same components and fewer hops, in a
number of rounds that grows with the logarithm of the longest path, until the edges are
stars, which counts per vertex tell. Rounds end at
tables in the shared folder; a minimum by key is pre-aggregated before each shuffle,
so a hot vertex is no hot task in the aggregation. Vertices of many edges (``HUB``) are
joined by broadcast, apart from the others: their number is at most the edges' by ``HUB``,
and it is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, written

MOST_ROUNDS = 60
#: Edges from which a vertex is a hub, and hubs that are broadcast at most (16 bytes each).
HUB, MOST_HUBS = 256, 1 << 20


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether the edges are stars, each vertex below one centre that is below none; and the
    most edges of a vertex."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    by = ends.groupBy("v").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    odd, most = by.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))), F.max("n")).first()
    return odd == 0, most or 0


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Large: neighbours above a vertex go to its least neighbour (itself included).
    Small: neighbours below a vertex, and itself, go to the least of them. A vertex has
    ``most`` edges at most."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    if most <= HUB:
        joined = both.join(least.drop("n"), "a")
    else:
        hubs = sized_broadcast(written(least.where(F.col("n") > HUB).select("a", "m"), "hubs"), MOST_HUBS)
        others = both.join(hubs, "a", "left_anti").join(least.where(F.col("n") <= HUB).drop("n"), "a")
        joined = both.join(hubs, "a").unionByName(others)
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(id, component)`` for each vertex of an edge between
    two vertices; the component is its least vertex. Nulls and loops are ignored."""
    own = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    current = written(own.distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        done, most = _shape(current)
        if done:
            break
        current = written(_star(current, True, most), "edges")
        most = current.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        current = written(_star(current, False, most), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("id")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))

"""Connected components as joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of edges (a, b): root is the component's smallest vertex.

    Each step links every neighbour of a vertex to the smallest one, in a grouping and a join,
    so no vertex's neighbours are gathered anywhere. The steps end when every edge is a link to
    a root; their number grows with the logarithm of the longest path. Self-loops and repeated
    edges are allowed; vertices are longs.
    """
    links = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = links.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        # large star: larger neighbours of u link to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours link to the smallest of them
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        used, links = links, saved(small.select("e.u", "e.v").filter("u <> v").distinct())
        discard(used)
    roots = links.select(F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select(F.col("root").alias("v"), "root"))

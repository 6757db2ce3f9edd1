"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(links: DataFrame, work: str) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node that it reaches.

    Each round hangs the neighbours of a node under their minimum, so the rounds needed grow with the logarithm of the
    number of nodes. A node's neighbours are never gathered: the minimum is a map-side combined aggregate that is joined
    back. Each round's links are a table below `work`.
    """
    a, b = F.col("a"), F.col("b")
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{work}/links")
    for i in count():
        # large star: neighbours above a node go to the node's minimum
        both = edges.unionAll(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.unionAll(edges.join(low, "a").select("a", F.col("m").alias("b"))).where(a != b).distinct()
        large = saved(large, f"{work}/large{i}")
        # small star: a node and its neighbours below go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = saved(small.where(a != b).distinct(), f"{work}/small{i}")
        ends = edges.select(a.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(b.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if open_.isEmpty():  # every node is a root or has one link, to a root
            roots = edges.select(b.alias("node")).distinct()
            return edges.select(a.alias("node"), b.alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of the edges ``(a long, b long)``; the root is its component's smallest node.

    Loops and repeated edges are allowed, null ends are ignored, no edge gives no row.
    Each round links the neighbours of every node to the smallest one.  Rounds grow with
    the logarithm of the component size; a node's neighbours are only ever aggregated or
    joined, never gathered.
    """
    stars = reliable_checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                stars.select("v", "v").distinct()
            )
        state = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour goes to the smallest one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # then every smaller neighbour and the node itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v")
        stars = reliable_checkpoint(small.distinct())

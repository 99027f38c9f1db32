"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges`` (columns ``a``, ``b``) but roots.

    Large-star and small-star steps alternate until every edge leads to a root, which takes a number
    of rounds logarithmic in the longest chain. Each round writes its edges to the shared folder. Minima are
    taken map-side first, so a node with a third of all edges is no burden. Loops and repeated
    edges do not matter; edges with a null end are ignored.
    """
    tops, lows = F.greatest("a", "b"), F.least("a", "b")
    links = materialise(edges.filter("a <> b").select(tops.alias("a"), lows.alias("b")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now

"""Connected components by alternating large and small stars.

Each round replaces every node's links by links to its smallest neighbour;
the number of rounds grows with the logarithm of the longest chain. Links
stay in written tables of the shared folder, never on the driver; a node of
any degree is summed before it is shuffled, and joins are left to be split
where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of the links: equal marks, equal links."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), roots included; root is
    the smallest node reachable. Loops, repeats and either order of a link
    are all right; no links give no rows."""
    edges = stored(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(smallest, "a")
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        rounds = stored(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(edges)
        edges, before, mark = rounds, mark, _mark(rounds)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

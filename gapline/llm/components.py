"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_links: int | None = None) -> DataFrame:
    """node, root: for each node of a link, the smallest node that it reaches.

    Large-star and small-star steps in turn (Kiveris et al., "Connected
    Components in MapReduce and Beyond") until the links no longer change: then
    each node hangs on its root.  Minima are combined before they are
    shuffled; the joins have one row per node on one side, so that Spark can
    split a node with very many links on the other.  Each round is written to
    the shared folder, and only a count and a checksum reach the driver.
    Nulls and links from a node to itself are left out.  ``most_links`` bounds
    their number where it is known.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), most_links)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w"))
        hung = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.select(F.explode(hung).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u > v").distinct(), before and 2 * before.n or most_links)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now

"""Connected components of a graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.session import stage


def connected(edges: DataFrame) -> DataFrame:
    """Rows (u, v): v is the smallest node that u reaches; nodes that are the smallest themselves have no row.

    ``edges`` has columns u and v. Each round ties every node to the smallest of its neighbours, first those larger
    than itself (large star), then those smaller (small star), until nothing changes; a logarithmic number of rounds
    does. Minima are combined before the shuffle and joined back, so no task gathers the neighbours of a node.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")

"""Connected components of an edge table by alternating stars, without driver-side state.

Every round makes two passes (large star, small star); a component of diameter d needs about log d
rounds. Minima are aggregated map-side, written, and joined back; the join has an exchange on both
sides and nothing above it that needs a key's rows together, so adaptive execution may split a hot
node. Written tables are dropped as soon as they have a successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges except roots themselves; the root is the smallest node reachable."""

    def stars(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(least, "u").select("u", "v", "m")

    now = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    seen = state(now)
    while seen[0]:
        # large star: each node's larger neighbours go to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = scratch.write(stars(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(least)
        # small star: each node and its smaller neighbours go to the smallest of them
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = stars(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(least, large, now)
        now, last, seen = after, seen, state(after)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

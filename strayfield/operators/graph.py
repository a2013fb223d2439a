"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strayfield.session import cut_lineage


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every ``u`` has one ``v`` and no ``v`` is a ``u``: each component hangs on its root, exactly."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high"))
    )
    uses = ends.groupBy("x").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return uses.where("low > 1 or (low > 0 and high > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with root the smallest node reachable, for undirected edges ``(u, v)``.

    Alternating large-star and small-star rounds (O(log^2 n)). A node's smallest neighbour comes from a
    map-side combined minimum and is joined back, so a hub of any degree is never gathered in one task.
    """
    current = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = cut_lineage(current)
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = (
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = cut_lineage(nxt)
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

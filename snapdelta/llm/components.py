"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay in tables in the shared folder: nothing is collected, and each step is one aggregation
(with map-side combining) and one join. A hub's edges are split over tasks once there are many of them
(``join_spread``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import drop_written, join_spread, written


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _joined(edges: DataFrame, low: DataFrame, hot: bool) -> DataFrame:
    return join_spread(edges, low.drop("n"), "u", low.select("u", "n")) if hot else edges.join(low.drop("n"), "u")


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both).withColumn("m", F.least("m", "u"))
    return _joined(both.where("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _low(down)
    return _joined(down, low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components", hub: int = 200_000) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) that isn't its component's smallest, as a written table.

    Null ends and loops are left out. Ends when every component is a star around its smallest node;
    the number of steps grows with the logarithm of the largest component. Tables of fewer than
    ``hub`` edges have no hub to split.
    """
    now = written(edges.select("u", "v").where("u <> v"), f"{name}-edges")
    n, seen = now.count(), None
    while n:
        following = written(_small_star(_large_star(now, n > hub), n > hub), f"{name}-edges")
        drop_written(now)
        now = following
        # a component is a star if no node is below one edge and above another, or below two
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = mark["n"]
        if mark == seen:
            break
        seen = mark
    path, now = now.written_path, now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    now.written_path = path
    return now

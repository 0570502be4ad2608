"""Joins whose hot keys are split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is split. There is at most one such key for so many rows, and a row of each is broadcast.
HOT = 1_000_000


def spread_join(many: DataFrame, other: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """An inner join on ``on``; a key with more than ``hot`` rows in ``many`` is dealt to several tasks.

    Rows of such a key are dealt by a hash of all their columns, and the key's rows of ``other`` are repeated for each
    part. Lazy: what is hot is told by an aggregation (with map-side combining) in the same plan.
    """
    counts = many.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot)
    parts = F.broadcast(counts.select(*on, F.ceil(F.col("__n") / hot).cast("int").alias("__parts")))
    whole = F.coalesce("__parts", F.lit(1))
    salted = many.join(parts, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), whole).cast("int")).drop("__parts")
    repeated = other.join(parts, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), whole - 1))).drop("__parts")
    return salted.join(repeated, [*on, "__salt"]).drop("__salt")

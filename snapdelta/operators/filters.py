"""Which classes take part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_excluded(entries: tuple[str, ...], name: str = "class_name") -> Column:
    """An entry occurs in the name anywhere but at its very start."""
    return reduce(lambda a, e: a | (F.locate(e, F.col(name), 2) > 0), entries, F.lit(False))


def without_excluded(classes: DataFrame, exclusions: DataFrame, entry: str = "value", name: str = "class_name") -> DataFrame:
    """The same for a table of entries of any size: the parts of each name that are as long as some entry are joined with them.

    Only the lengths that entries have come to the driver, and of those only the ones up to the longest name's.
    """
    entries = exclusions.where(F.trim(entry) != "").select(F.col(entry).alias("__part")).distinct()
    longest = classes.agg(F.max(F.length(name))).first()[0] or 0
    lengths = [r[0] for r in entries.select(F.length("__part").alias("n")).where(F.col("n") < longest).distinct().collect()]
    if not lengths:
        return classes
    names = classes.select(F.col(name).alias("__name")).distinct()
    parts = F.flatten(F.transform(F.array(*map(F.lit, sorted(lengths))), lambda n: F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length("__name"), F.lit(2))), lambda at: at + n - 1 <= F.length("__name")), lambda at: F.substring(F.col("__name"), at, n))))
    found = names.select("__name", F.explode(F.array_distinct(parts)).alias("__part")).join(entries, "__part", "left_semi").select("__name").distinct()
    return classes.join(found, F.col(name) == F.col("__name"), "left_anti")


def is_empty() -> Column:
    none = lambda c: ~F.exists(c, lambda m: m["analysed"])
    return none("methods") & none("fields")

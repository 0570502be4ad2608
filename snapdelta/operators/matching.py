"""Candidates, best matches and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deleted(a: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names of classes of the first snapshot without candidate."""
    return a.select(F.col("class_name").alias("class_a")).join(pairs, "class_a", "left_anti").withColumnRenamed("class_a", "class_name")


def added(b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names of classes of the second snapshot that are no candidate."""
    return b.select(F.col("class_name").alias("class_b")).join(pairs, "class_b", "left_anti").withColumnRenamed("class_b", "class_name")


def name_absent(pairs: DataFrame, same: Column | None = None) -> DataFrame:
    """Classes with candidates none of which has their own name (or what ``same`` says of a pair)."""
    own = F.col("class_a") == F.col("class_b") if same is None else same
    return pairs.groupBy("class_a").agg(F.bool_or(own).alias("__own")).where(~F.col("__own")).select("class_a")


def best_match(scored: DataFrame, gather: Callable[[str], Column] = F.collect_set) -> DataFrame:
    """(class_a, score, candidates): the best score with all ties, told on nine decimals; candidates sorted, by default each name once."""
    key = F.round("score", 9)
    rank = F.rank().over(Window.partitionBy("class_a").orderBy(key.desc()))
    return scored.withColumn("__r", rank).where("__r = 1").groupBy("class_a").agg(F.max("score").alias("score"), F.sort_array(gather("class_b")).alias("candidates"))


def best_above(scored: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, score): one best candidate with at least the threshold, the first by name of equals."""
    order = Window.partitionBy("class_a").orderBy(F.round("score", 9).desc(), "class_b")
    return scored.where(F.col("score") >= threshold).withColumn("__r", F.row_number().over(order)).where("__r = 1").select("class_a", "class_b", "score")


def candidate_report(a: DataFrame, pairs: DataFrame, obfuscated: bool = False, same: Column | None = None) -> DataFrame:
    """(class_a, line): each class with its sorted candidates, and a mark if its own name isn't among them."""
    own = F.col("class_a") == F.col("class_b") if same is None else same
    grouped = pairs.groupBy("class_a").agg(F.sort_array(F.collect_set("class_b")).alias("c"), F.bool_or(own).alias("own"))
    rows = a.select(F.col("class_name").alias("class_a")).join(grouped, "class_a", "left")
    mark = F.lit("") if obfuscated else F.when(F.col("own"), "").otherwise(" (own name missing)")
    line = F.when(F.col("c").isNull(), F.concat("class_a", F.lit(" -> none"))).otherwise(F.concat("class_a", mark, F.lit(" -> ["), F.array_join("c", " "), F.lit("]")))
    return rows.select("class_a", line.alias("line"))


def summary(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of counts; the mean of candidates is null where there are none. Unmapped opcodes are those of no family."""
    found = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("class_a").alias("with_candidates"))
    side = lambda df, s: df.agg(F.count("*").alias(f"classes_{s}"), F.coalesce(F.sum("unmapped"), F.lit(0)).alias(f"unmapped_{s}"))
    counts = side(a, "a").crossJoin(side(b, "b")).crossJoin(found)  # one row each
    return counts.select("classes_a", "classes_b", "unmapped_a", "unmapped_b", "pairs", "with_candidates", (F.col("classes_a") - F.col("with_candidates")).alias("without_candidates"), F.try_divide("pairs", "with_candidates").alias("mean_candidates"))

"""Structural similarity of class pairs: fields 16, class 38, methods 31 and code 15 hundredths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.functions.bits import bags, best_distances, packed, packed_distances
from snapdelta.functions.scores import avg_or_zero, code_score, code_sequence, count_penalty, jaccard, mean_penalty, snap
from snapdelta.operators.tiles import SETS, scored
from snapdelta.operators.features import kinds, members, peer_access, peers


def _set(values: Column) -> Column:
    return F.array_distinct(values)


def _all(methods: Column, refs: str) -> Column:
    return F.flatten(F.transform(methods, lambda m: peer_access(m[refs])))


def _sizes(methods: Column, refs: str) -> Column:
    return F.filter(F.transform(methods, lambda m: F.size(m[refs])), lambda n: n > 0)


def score_columns() -> dict[str, Column]:
    """What a pair's score needs of each class, computed once a class."""
    declared, analysed = members("fields", "declared"), members("fields", "analysed")
    methods = members("methods", "analysed")
    get = lambda values, name: F.transform(values, lambda m: m[name])
    return {
        "n_methods": F.size(members("methods", "declared")), "n_fields": F.size(declared), "n_analysed_fields": F.size(analysed), "n_implements": F.size("implements"),
        "from_peers": peers(F.col("xref_from")), "to_peers": peers(F.col("xref_to")), "from_kinds": _set(kinds(F.col("xref_from"))), "to_kinds": _set(kinds(F.col("xref_to"))),
        "f_descriptors": _set(get(declared, "descriptor")), "f_access": _set(get(declared, "access")), "reads": avg_or_zero(get(analysed, "n_read")), "writes": avg_or_zero(get(analysed, "n_write")),
        "m_descriptors": _set(get(methods, "descriptor")), "m_access": _set(get(methods, "access")),
        "m_from_access": _set(_all(methods, "xref_from")), "m_to_access": _set(_all(methods, "xref_to")), "m_from": avg_or_zero(_sizes(methods, "xref_from")), "m_to": avg_or_zero(_sizes(methods, "xref_to")),
        "code": code_sequence(F.col("methods")),
    }


def score_features(classes: DataFrame) -> DataFrame:
    return classes.select("class_name", *(c.alias(n) for n, c in score_columns().items()))


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(f"a.{name}"), F.col(f"b.{name}")


def fields_score() -> Column:
    a, b = _pair("n_analysed_fields")
    both = 0.05 * jaccard(*_pair("f_descriptors")) + 0.05 * jaccard(*_pair("f_access")) + mean_penalty(0.03, *_pair("reads")) + mean_penalty(0.03, *_pair("writes"))
    return F.when((a == 0) & (b == 0), 0.16).when((a == 0) | (b == 0), 0.0).otherwise(both)


def _refs(direction: str) -> Column:
    a, b = _pair(f"{direction}_peers")
    one = 0.05 * 0.9 / F.greatest(a, b)
    return F.when((a == 0) & (b == 0), 0.1).when((a == 0) | (b == 0), one).otherwise(count_penalty(0.05, a, b) + 0.05 * jaccard(*_pair(f"{direction}_kinds")))


def class_score() -> Column:
    return count_penalty(0.08, *_pair("n_methods")) + count_penalty(0.06, *_pair("n_fields")) + _refs("from") + _refs("to") + count_penalty(0.04, *_pair("n_implements"))


def method_score() -> Column:
    """Summed from left to right as the SQL has it: another order of sums can tip the last millionth."""
    from_access, from_refs, to_access, to_refs = (part for d in ("from", "to") for part in (0.04 * jaccard(*_pair(f"m_{d}_access")), mean_penalty(0.04, *_pair(f"m_{d}"))))
    return 0.08 * jaccard(*_pair("m_descriptors")) + 0.07 * jaccard(*_pair("m_access")) + from_access + from_refs + to_access + to_refs


def attach(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with both classes' score features, as ``a`` and ``b``."""
    left = a.select(F.col("class_name").alias("class_a"), F.struct(*(c for c in a.columns if c != "class_name")).alias("a"))
    right = b.select(F.col("class_name").alias("class_b"), F.struct(*(c for c in b.columns if c != "class_name")).alias("b"))
    return pairs.join(left, "class_a").join(right, "class_b")


PARTS = {"fields_score": fields_score, "class_score": class_score, "method_score": method_score}


def _total() -> Column:
    return snap(F.col("fields_score") + F.col("class_score") + F.col("method_score") + F.col("code_score"))


#: Scores that differ by less can come out equal: of those near one, and of those that agree in nine decimals.
NEAR = 2e-7
#: Pairs of a class that are held at once and aligned one after the other.
ALIGNED = 256


#: Classes of a side that a task holds in memory; and parts of a side at least, so that there are tasks enough.
PART, PARTS_AT_LEAST = 25_000, 4


def _code_id() -> Column:
    return F.substring(F.unhex(F.sha2("code", 256)), 1, 16)


def small(features: DataFrame) -> DataFrame:
    """Features with codes and sets packed, and the codes' lengths; those that are so already stay."""
    if "sets" in features.columns and dict(features.dtypes)["code"] == "binary":
        return features
    spark, made = features.sparkSession, {}
    if dict(features.dtypes)["code"] != "binary":
        made = {"code": packed(spark, F.col("code")), "code_bits": F.length("code")}
    if "sets" not in features.columns:
        made["sets"] = bags(spark, *map(F.col, SETS))
    return features.withColumns(made).drop(*SETS)


def _tiles(pairs: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, pairs) by tile: a part of the one side against a part of the other. A class's features go to a tile
    once, however many pairs it has there, so what is shuffled follows the classes and not the pairs."""
    every = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    parts = every.agg(F.greatest(F.lit(PARTS_AT_LEAST), F.ceil(F.count("*") / (2 * PART))).cast("int").alias("parts"))
    at = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    met = pairs.select("class_a", "class_b").crossJoin(F.broadcast(parts)).select("class_a", "class_b", (at("class_a") * F.col("parts") + at("class_b")).alias("tile"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"class_{s}").alias("class_name")) for s in "ab"))
    needed = met.select("tile", F.explode(sides).alias("s")).select("s.side", "s.class_name", F.col("tile").alias("at")).distinct()
    return needed.join(small(every).withColumn("code_id", _code_id()).drop("code"), ["side", "class_name"]), met


def _in_tiles(pairs: DataFrame, a: DataFrame, b: DataFrame, *, ids: bool = False, near: float | None = None) -> DataFrame:
    """(class_a, class_b, three sub-scores, same, n_x, n_y), with ``ids`` also the codes' digests, the smaller one first.
    With ``near`` without the pairs whose upper bound is below the best lower one that their class has in a tile by more."""

    def run(features: pa.Table, met: pa.Table) -> pa.Table:
        return scored(features, met, ids, near)

    features, met = _tiles(pairs, a, b)
    kinds = "class_a string, class_b string, fields_score double, class_score double, method_score double, same boolean, n_x int, n_y int" + ", low_id binary, high_id binary" * ids
    return features.groupBy("at").cogroup(met.groupBy("tile")).applyInArrow(run, kinds)


def sub_scores(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(class_a, class_b, three sub-scores, same, n_x, n_y): codes stay behind, but for whether they are the same and their lengths."""
    return _in_tiles(pairs, a, b)


def _dealt(rows: DataFrame, key: str, other: str) -> tuple[DataFrame, int]:
    """With the part of its key that a row is dealt to, and how many tasks: few rows can take long to align, so there
    are more tasks than their bytes ask for."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64(other), F.ceil(F.count("*").over(Window.partitionBy(key)) / ALIGNED)).cast("int")
    return rows.withColumn("part", part), tasks


def _totalled(distances: DataFrame) -> DataFrame:
    return distances.withColumn("code_score", code_score(F.col("distance"))).withColumn("score", _total()).select("class_a", "class_b", *PARTS, "code_score", "score")


def _aligned(parts: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Contenders with their distances. Packed codes are attached last, and only to pairs of different ones; of a class the
    most promising pairs are aligned first, and a pair that can't reach its class's best so far is left out."""
    rows, tasks = _dealt(parts, "class_a", "class_b")
    code = lambda df, s, c: df.select(F.col("class_name").alias(f"class_{s}"), F.col("code").alias(c))
    left = rows.join(code(b, "b", "y"), "class_b").withColumn("y", F.when(~F.col("same"), F.col("y")))  # the plan has what goes before once
    row = F.struct((-F.col("upper")).alias("order"), "class_b", *PARTS, "base", "upper", "y")
    grouped = left.repartition(tasks, "class_a").groupBy("class_a", "part").agg(F.max("best").alias("best"), F.sort_array(F.collect_list(row)).alias("rows"))
    met = grouped.join(code(a, "a", "x").repartition(tasks, "class_a"), "class_a")
    found = best_distances(parts.sparkSession, F.col("x"), F.col("rows.y"), F.col("rows.base"), F.col("rows.upper"), F.col("best"))
    shown = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("class_b", *PARTS))))
    each = met.select("class_a", shown.alias("rows"), found.alias("found")).select("class_a", F.explode(F.arrays_zip("rows", "found")).alias("z"))
    return each.where("z.found >= 0").select("class_a", "z.rows.*", F.col("z.found").alias("distance"))


def _code_distances(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(low_id, high_id, distance) of the different codes that meet in ``pairs``, each two of them once however many classes have them.
    Codes are shuffled packed, as each pair carries one."""
    spark, a, b = pairs.sparkSession, small(a), small(b)
    ids = lambda df, s: df.select(F.col("class_name").alias(f"class_{s}"), _code_id().alias(f"id_{s}"))
    met = pairs.join(ids(a, "a"), "class_a").join(ids(b, "b"), "class_b").where("id_a <> id_b")
    found = met.select(F.least("id_a", "id_b").alias("low_id"), F.greatest("id_a", "id_b").alias("high_id")).distinct()
    rows, tasks = _dealt(found, "low_id", "high_id")
    own = lambda df: df.select(_code_id().alias("id"), "code")
    codes = own(a).unionByName(own(b)).dropDuplicates(["id"])
    named = lambda i, c: codes.select(F.col("id").alias(i), F.col("code").alias(c))
    keys = ["low_id", "part"]
    left = rows.join(named("high_id", "y"), "high_id").repartition(tasks, *keys)
    right = rows.select(*keys).distinct().join(named("low_id", "x"), "low_id").repartition(tasks, *keys)
    return left.join(right, keys).select("low_id", "high_id", packed_distances(spark, F.col("x"), F.col("y")).alias("distance"))


def _bounded(parts: DataFrame) -> DataFrame:
    """With bounds of each pair's total, and the best lower one of its class: the distance lies between the difference and the greater of the lengths."""
    base = F.col("fields_score") + F.col("class_score") + F.col("method_score")
    gap, most = F.abs(F.col("n_x") - F.col("n_y")), F.greatest("n_x", "n_y")
    upper = base + F.when(F.col("same"), 0.15).otherwise(0.12 / F.sqrt(F.greatest(gap, F.lit(1))))
    lower = base + F.when(F.col("same"), 0.15).otherwise(0.12 / F.sqrt(most))
    bounds = parts.withColumns({"base": base, "upper": upper, "lower": lower})
    return bounds.withColumn("best", F.max("lower").over(Window.partitionBy("class_a")))


def score_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(class_a, class_b, the four sub-scores, score); ``a`` and ``b`` come from ``score_features``, or are ``small`` ones."""
    a, b = small(a), small(b)
    parts = _in_tiles(pairs, a, b, ids=True).join(_code_distances(pairs, a, b), ["low_id", "high_id"], "left")
    return _totalled(parts.withColumn("distance", F.when(F.col("same"), 0).otherwise(F.col("distance"))))


def score_contenders(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``score_pairs`` of the pairs that can be a class's best; only those are aligned.

    Pairs whose upper bound is below their class's best lower bound are left out before codes are attached, most of them
    before they are shuffled.
    """
    a, b = small(a), small(b)
    return _totalled(_aligned(_bounded(_in_tiles(pairs, a, b, near=NEAR)).where(F.col("upper") >= F.col("best") - NEAR), a, b))

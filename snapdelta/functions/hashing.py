"""FNV-1a and 32-bit SimHash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0x811C9DC5, 16777619, 0xFFFFFFFF


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a bigint; native, two hex digits of the text at a time."""
    digits = F.hex(F.encode(text, "UTF-8"))
    starts = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    step = lambda h, at: (h.bitwiseXOR(F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("bigint")) * F.lit(PRIME).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint"))
    start = F.lit(OFFSET).cast("bigint")
    return F.when(F.length(digits) == 0, start).otherwise(F.aggregate(starts, start, step))


def fnv1a32_py(text: str) -> int:
    h = OFFSET
    for byte in text.encode():
        h = (h ^ byte) * PRIME & MASK
    return h


def simhash32_rows(features: DataFrame, keys: list[str], feature: str = "feature", weight: str = "n", hash_fn=fnv1a32) -> DataFrame:
    """(keys, simhash) from rows of (keys, feature, weight): a bit is 1 if over half the weight has it.

    Equal features are summed before they are hashed, so a feature is hashed once a key.
    """
    hashed = features.groupBy(*keys, feature).agg(F.sum(weight).alias("__n")).withColumn("__h", hash_fn(F.col(feature)))
    total, votes = F.sum("__n"), [F.sum(F.col("__n") * F.shiftright("__h", b).bitwiseAND(F.lit(1).cast("bigint"))) for b in range(32)]
    packed = sum((F.when(2 * v > total, F.lit(1 << b)).otherwise(0).cast("bigint") for b, v in enumerate(votes)), F.lit(0).cast("bigint"))
    return hashed.groupBy(*keys).agg(packed.alias("simhash"))


def simhash32_py(bag, known: dict[str, int], hash_fn=fnv1a32_py) -> int:
    if not len(bag):
        return 0
    for f in set(bag).difference(known):
        known[f] = hash_fn(f)
    hashes = np.fromiter(map(known.__getitem__, bag), ">u4", len(bag))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 4), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bag)).tobytes(), "big")


def never_null(made: Column) -> Column:
    """Of a column made in Python that is never null anyway, but isn't known not to be: joins on it would get
    a filter for nulls, which the optimizer pushes below where the Python runs, and tasks fail there."""
    return F.coalesce(made, F.lit(0).cast("bigint"))


def simhash32(bag: Column, hash_fn=fnv1a32_py, remember: int = 500_000) -> Column:
    """SimHash of an array of strings, in Arrow batches: nothing is exploded or shuffled. Null and empty bags give 0.

    ``hash_fn`` gives a text's unsigned 32-bit hash.
    """

    @F.pandas_udf("bigint")
    def run(column: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for b in column:
            if len(known) > remember:
                known.clear()
            out.append(simhash32_py(b if b is not None else (), known, hash_fn))
        return pd.Series(out, index=column.index, dtype="int64")

    return never_null(run(bag))


def simhash32_numbered(numbers: Column, names: list[str], hash_fn=fnv1a32_py) -> Column:
    """SimHash of an array of numbers that stand for ``names``: they are counted, so that long arrays cost little."""

    @F.pandas_udf("bigint")
    def run(column: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.array([hash_fn(n) for n in names], ">u4").view(np.uint8).reshape(-1, 4), axis=1).astype(np.int64)
        out = []
        for b in column:
            weights = np.bincount(b, minlength=len(names)) if b is not None and len(b) else np.zeros(len(names), np.int64)
            out.append(int.from_bytes(np.packbits(2 * (weights @ bits) > weights.sum()).tobytes(), "big"))
        return pd.Series(out, index=column.index, dtype="int64")

    return never_null(run(numbers))

"""Set similarity, penalties, averages and code sequences as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from snapdelta.functions.bits import bit_distances
from snapdelta.functions.families import family_value


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def avg_or_zero(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(values) == 0, 0.0).otherwise(total / F.size(values))


def count_penalty(weight: float, a: Column, b: Column) -> Column:
    return F.when(a == b, weight).otherwise(weight * 0.9 / F.abs(a - b))


def mean_penalty(weight: float, a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b) < 1, weight).otherwise(weight * 0.9 / F.abs(a - b))


def method_code_sig(values: Column) -> Column:
    """Length and exclusive or of a method's family values."""
    return F.shiftleft(F.size(values).cast("bigint"), 4).bitwiseOR(F.aggregate(values, F.lit(0), lambda a, x: a.bitwiseXOR(x)).cast("bigint"))


def code_values(opcodes: Column) -> Column:
    """Family values of the mapped opcodes."""
    return F.filter(F.transform(opcodes, family_value), lambda v: v.isNotNull())


def code_sequence(methods: Column) -> Column:
    """Bits of a class's code: by signature the last method's values, in ascending order of signatures.

    Four bits a value; leading zeros vanish, and no code is "0".
    """
    own = F.filter(methods, lambda m: m["declared"] & m["opcodes"].isNotNull())
    shaped = F.transform(own, lambda m: F.struct(code_values(m["opcodes"]).alias("v"), m["idx"].alias("idx")))
    signed = F.sort_array(F.transform(shaped, lambda m: F.struct(method_code_sig(m["v"]).alias("sig"), m["idx"].alias("idx"), m["v"].alias("v"))))
    last = F.transform(F.array(signed), lambda s: F.filter(s, lambda m, k: ~F.coalesce(F.get(s, k + 1)["sig"] == m["sig"], F.lit(False))))[0]
    bits = F.array_join(F.transform(F.flatten(F.transform(last, lambda m: m["v"])), lambda v: F.lpad(F.bin(v), 4, "0")), "")
    short = F.ltrim(bits, F.lit("0"))
    return F.when(short == "", "0").otherwise(short)


#: Columns for which a part of the longer string is cut out at once.
COLUMNS = 1024


def _band_distance(a: str, b: str, edge: int) -> int:
    """Edit distance of ``a`` and the shorter ``b`` by ways that leave the band between the two corners' diagonals by at
    most ``edge`` on either side (Hyyro 2003).

    A way of cost d leaves it by (d - the lengths' difference) / 2 at most, so the result is the edit distance if
    it is no greater than the difference and 2 * ``edge`` + 1, and never below it. Bit k of column j is row
    j - ``edge`` + k, so the band moves down a row with each column.
    """
    corner = len(a) - len(b) + edge
    full = (1 << (corner + edge + 1)) - 1
    ones = int(a[::-1], 2)
    rows = {"0": ((1 << len(a)) - 1 ^ ones) << edge, "1": ones << edge}
    rise, fall, distance = full >> edge << edge, 0, len(a) - len(b)
    for start in range(0, len(b), COLUMNS):
        cut = (full + 1 << COLUMNS) - 1
        near = {bit: places >> start & cut for bit, places in rows.items()}
        for at, c in enumerate(b[start : start + COLUMNS]):
            same = near[c] >> at
            diagonal = (((same & rise) + rise ^ rise) | same | fall) & full
            distance += 1 - (diagonal >> corner & 1)
            up = fall | full ^ (diagonal | rise)
            down = diagonal & rise
            diagonal >>= 1
            rise = down | full ^ (diagonal | up)
            fall = diagonal & up
    return distance


def bit_distance(a: str, b: str) -> int:
    """Edit distance of two strings of bits, 64 cells of the table and more at once (Myers 1999, as Hyyro has it for whole strings).

    What both begin and end with is left out first; a column of the table is two whole numbers, whose
    bits tell where the values rise and fall. Of the table a narrow band is filled first; the distance along it
    is no less than the true one and tells how wide a band surely holds the best way.
    """
    if a == b:
        return 0
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common beginning
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) < len(b):
        a, b = b, a
    letters = iter(a)
    if all(bit in letters for bit in b):  # all of b in order, so the rest of a is put in
        return len(a) - len(b)
    # the longer one lies along the bits, so that there are fewer columns
    gap = len(a) - len(b)
    edge = max(32, len(b) // 64, min(gap, len(b)) // 6)
    while gap + 2 * edge < len(a):
        distance = _band_distance(a, b, edge)
        if distance - gap <= 2 * edge + 1:
            return distance
        edge = (distance - gap) // 2
    width, last = len(a), len(a) - 1
    full = (1 << width) - 1
    ones = int(a[::-1], 2)
    places = {"0": full ^ ones, "1": ones}
    rise, fall, distance = full, 0, width
    for c in b:
        same = places[c] | fall
        diagonal = ((((same & rise) + rise) ^ rise) | same) & full
        up = fall | full ^ (rise | diagonal)
        down = rise & diagonal
        distance += (up >> last) - (down >> last)
        up = up << 1 | 1
        fall = up & diagonal
        rise = (down << 1 | full ^ (up | diagonal)) & full
    return distance


#: Bits of the stretches that are counted for a lower bound of the edit distance.
STRETCH = 16


def stretches(bits: str) -> np.ndarray:
    """How often each stretch of ``STRETCH`` bits occurs."""
    values, width = np.frombuffer(bits.encode(), np.uint8).astype(np.int64) - ord("0"), 1
    if len(values) < STRETCH:
        return np.zeros(1 << STRETCH, np.int32)
    while width < STRETCH:
        values, width = values[: len(values) - width] << width | values[width:], 2 * width
    return np.bincount(values, minlength=1 << STRETCH).astype(np.int32)


def least_distance(a: np.ndarray, b: np.ndarray, gap: int) -> int:
    """A lower bound of the edit distance: an edit takes and gives at most ``STRETCH`` stretches; and it is no less than the lengths' difference."""
    return max(gap, -(-int(np.abs(a - b).sum()) // (2 * STRETCH)))


def edit_distance(a: Column, b: Column, spark: SparkSession | None = None) -> Column:
    """Edit distance of strings of bits, in the JVM; the built-in one takes a second for 10,000 bits."""
    return bit_distances(spark or SparkSession.active(), a, b)


def code_score(distance: Column) -> Column:
    return F.when(distance == 0, 0.15).otherwise(0.12 / F.sqrt(distance))


def snap(score: Column) -> Column:
    """Scores a rounding error below one are one."""
    return F.when(1 - score < 1e-7, 1.0).otherwise(score)


def micro(score: Column) -> Column:
    """A score in millionths, rounded half up."""
    return F.floor(score * 1e6 + 0.5).cast("bigint")

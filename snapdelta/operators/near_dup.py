"""Signatures and the Hamming-distance join.

128 bits are four 32-bit components. k + 1 blocks of the bits, taken in turn from the components,
can't all differ in two signatures that differ in k bits: so an equality join on blocks, with the
distance checked afterwards, finds every pair. Taking turns keeps blocks selective where a whole
component is common.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.families import NAMES
from snapdelta.functions.hashing import fnv1a32, fnv1a32_py, simhash32, simhash32_numbered, simhash32_rows
from snapdelta.operators.features import BAGS, COMPONENTS, code_families
from snapdelta.operators.skew import HOT, spread_join

KEYS = ["snapshot", "class_name"]


def with_signature(classes: DataFrame, hash_fn=fnv1a32_py) -> DataFrame:
    """Adds the four components; narrow, by Arrow batches. ``hash_fn`` gives a text's unsigned 32-bit hash.

    Code is hashed by the counts of its families, the other bags feature by feature.
    """
    made = {c: simhash32(bag(), hash_fn) for c, bag in BAGS.items() if c != "code_sh"}
    return classes.withColumns(made | {"code_sh": simhash32_numbered(code_families(), NAMES, hash_fn)})


def component_rows(classes: DataFrame) -> DataFrame:
    """(snapshot, class_name, component, feature, n) of every bag."""
    bags = F.create_map(*(x for c, bag in BAGS.items() for x in (F.lit(c), bag())))
    return classes.select(*KEYS, F.explode(bags).alias("component", "bag")).select(*KEYS, "component", F.explode("bag").alias("feature")).groupBy(*KEYS, "component", "feature").agg(F.count("*").alias("n"))


def native_components(classes: DataFrame, hash_fn=fnv1a32) -> DataFrame:
    """(snapshot, class_name, component, simhash) by JVM operators only; an empty bag gives 0.

    ``hash_fn`` makes a column of unsigned 32-bit hashes of a column of texts.
    """
    every = classes.select(*KEYS, F.explode(F.array(*map(F.lit, COMPONENTS))).alias("component"))
    made = simhash32_rows(component_rows(classes), [*KEYS, "component"], hash_fn=hash_fn)
    return every.join(made, [*KEYS, "component"], "left").select(*KEYS, "component", F.coalesce("simhash", F.lit(0).cast("bigint")).alias("simhash"))


def signature_hex() -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(c)), 8, "0") for c in COMPONENTS))


def block_bounds(k: int, bits: int = 128) -> list[tuple[int, int]]:
    """(offset, width) of the k + 1 blocks; the last takes what is left."""
    width = bits // (k + 1)
    return [(i * width, width if i < k else bits - k * width) for i in range(k + 1)]


def block_parts(k: int, prefix: str = "") -> list[list[Column]]:
    """For each block its bits of each component. Bit order is component by component in turn, from the top."""
    out = []
    for offset, width in block_bounds(k):
        parts = []
        for number, c in enumerate(COMPONENTS):
            rows = [p // 4 for p in range(offset, offset + width) if p % 4 == number]
            low, n = (31 - rows[-1], len(rows)) if rows else (0, 0)
            parts.append(F.shiftright(F.col(prefix + c), low).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")))
        out.append(parts)
    return out


def blocks(signatures: DataFrame, k: int = 3) -> DataFrame:
    """A row for each block: its number and its bits of each component (p0 to p3)."""
    rows = [F.struct(F.lit(i).alias("block"), *(p.alias(f"p{j}") for j, p in enumerate(parts))) for i, parts in enumerate(block_parts(k))]
    return signatures.select("*", F.explode(F.array(*rows)).alias("__b")).select(*signatures.columns, "__b.*")


def hamming(left: str = "", right: str = "r_") -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(left + c).bitwiseXOR(F.col(right + c))) for c in COMPONENTS))


def near_dup_signatures(a: DataFrame, b: DataFrame, k: int = 3, hot: int = HOT) -> DataFrame:
    """Pairs of distinct signatures within distance k: (components, r_ components, hamming).

    A pair that meets in several blocks is taken in the first of them, so nothing has to be made distinct. A
    block that many signatures of a side share is split.
    """
    left = blocks(a.select(*COMPONENTS).distinct(), k)
    right = blocks(b.select(*(F.col(c) for c in COMPONENTS)).distinct(), k)
    keys = ["block", "p0", "p1", "p2", "p3"]
    right = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in COMPONENTS))
    met = spread_join(left, right, keys, hot)
    same = lambda i: reduce(lambda x, y: x & y, (p == q for p, q in zip(block_parts(k)[i], block_parts(k, "r_")[i], strict=True)))
    earlier = F.lit(False)
    for i in range(k):
        earlier = earlier | ((F.col("block") > i) & same(i))
    distance = hamming()
    return met.where((distance <= k) & ~earlier).select(*COMPONENTS, *(f"r_{c}" for c in COMPONENTS), distance.cast("bigint").alias("hamming"))


def near_dup_join(a: DataFrame, b: DataFrame, k: int = 3, hot: int = HOT) -> DataFrame:
    """(class_a, class_b, hamming) of every pair within distance k.

    Signatures are joined once however many classes share them; only then names are attached, and the
    names of a signature that very many classes have are dealt to several tasks.
    """
    found = near_dup_signatures(a, b, k, hot)
    names_a = a.select(F.col("class_name").alias("class_a"), *COMPONENTS)
    names_b = b.select(F.col("class_name").alias("class_b"), *(F.col(c).alias(f"r_{c}") for c in COMPONENTS))
    named = spread_join(names_a, found, COMPONENTS, hot)
    return spread_join(names_b, named, [f"r_{c}" for c in COMPONENTS], hot).select("class_a", "class_b", "hamming")

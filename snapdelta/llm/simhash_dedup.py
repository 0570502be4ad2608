"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight
bytes, so they share at least five (position, byte) entries. Posting lists of single entries hold N / 256
fingerprints each and would pair up everything, so the index is addressed by four entries at once: the
fourteen position quadruples a^b^c^d = 0 of {0..7} (the Steiner system S(3,4,8), which holds its own
complements) leave, for any three spoilt positions, one quadruple untouched. So every linked pair
meets in some posting list, and a list of random fingerprints has N / 2^32 entries.

The entries that address a list are four hits of each of its pairs. The hits in the entries of the
other four positions are tallied pair by pair (``tally``), pairs that don't reach the five that
three spoilt bytes guarantee are left out, and only the rest is verified bit by bit. The count filter
loses nothing, so the verified links are the same without it; it spares the verification of pairs that
meet by four common bytes alone.

Equal fingerprints are one node from the start, so groups of copies never become pairs. A posting
list returns a spanning forest of its links (member, smallest member), never all pairs; a list
longer than ``block`` is cut into blocks that are compared two at a time in tasks of their own.

Defined cases: null text is empty text; a text without words has fingerprint zero and is linked like any
other; texts of any length are hashed whole. Rows count each, with repeated ids too, and rows with a null
id get a component as well: the smallest id that is not null, or null. Other columns are carried as one
struct, so their names can't clash. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import drop_written, join_spread, rows_of, small_batches, text_of, unpacked, written
from snapdelta.llm.components import connected_components

POSITIONS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
MAX_BITS, MIN_SHARED = 3, 5
SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned. Words are lower-cased in A-Z alone and end at ASCII white space, as bytes.split() does."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, shingles, _CHUNK):
        hashes = np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(start, min(shingles, start + _CHUNK))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long. Narrow; only the text reaches Python."""

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in column], np.uint64).view(np.int64), index=column.index)

    return df.withColumn(into, run(text_of(text)))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many (position, byte) entries each pair of uint64 shares."""
    return ((a ^ b).reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then the exact check of the pairs that it retains."""
    out = tally(a, b) >= MIN_SHARED
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= MAX_BITS
    return out


def _small_lists(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted posting lists: each entry's smallest linked entry by way of links in its list."""
    n = len(keys)
    left, right, step = [], [], 1
    at = np.arange(n - 1)
    while len(at := at[at + step < n][keys[at[at + step < n]] == keys[at[at + step < n] + step]]):
        hit = at[linked(fps[at], fps[at + step])]
        left.append(hit)
        right.append(hit + step)
        step += 1
    label = np.arange(n)
    if not left:
        return fps[:0], fps[:0]
    u, v = np.concatenate(left), np.concatenate(right)
    while True:
        before = label.copy()
        np.minimum.at(label, v, label[u])
        np.minimum.at(label, u, label[v])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _large_list(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long list: breadth-first, where each entry is only held against those not reached yet."""
    members, roots, left = [], [], fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            hit = linked(np.full(len(left), front.pop()), left)
            if hit.any():
                reached = left[hit]
                front += list(reached)
                members.append(reached)
                roots.append(np.full(len(reached), root))
                left = left[~hit]
    return (np.concatenate(members), np.concatenate(roots)) if members else (fps[:0], fps[:0])


def _forest(batches: Iterator[pd.DataFrame], long_list: int = 64) -> Iterator[pd.DataFrame]:
    """Batches sorted by (key, part); lists may go on over batch ends, so the last one is held back."""
    held: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        change = (rows[["key", "low", "high"]].diff().fillna(1) != 0).any(axis=1).to_numpy()
        group = np.cumsum(change)
        fps = rows["fp"].to_numpy().view(np.uint64)
        sizes = np.bincount(group)[group]
        small = (sizes > 1) & (sizes <= long_list)
        out = [_small_lists(group[small], fps[small])]
        long_rows = np.flatnonzero(sizes > long_list)
        if len(long_rows):
            for part in np.split(long_rows, np.flatnonzero(np.diff(group[long_rows])) + 1):
                out.append(_large_list(np.unique(fps[part])))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]).view(np.int64) for i, c in enumerate(("u", "v"))})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        end = rows.iloc[-1]
        last = (rows["key"] == end["key"]) & (rows["low"] == end["low"]) & (rows["high"] == end["high"])
        held = rows[last].reset_index(drop=True)
        if not last.all():
            yield solve(rows[~last].reset_index(drop=True))
    if held is not None:
        yield solve(held)


def links(nodes: DataFrame, block: int = 4096) -> DataFrame:
    """(u, v) edges whose components are those of all links between the distinct ``fp`` of ``nodes``."""
    position = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [
        sum((F.shiftleft(position[p], 8 * k) for k, p in enumerate(q)), F.lit(number << 32).cast("long"))
        for number, q in enumerate(POSITIONS)
    ]
    postings = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = written(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-hot")
    parts = F.ceil(F.col("n") / (block // 2)).cast("int").alias("parts")
    dealt = (
        join_spread(postings, hot.select("key", parts), "key", hot, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )
    edges = written(dealt.mapInPandas(_forest, "u long, v long").distinct(), "simhash-links")
    drop_written(hot)
    return edges


def _rooted(fingerprinted: DataFrame, id_col: str) -> DataFrame:
    """(fp, low_id, n, root), written: each distinct fingerprint with its smallest id, its rows and what names its group."""
    nodes = written(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("low_id"), F.count("*").alias("n")), "simhash-nodes")
    edges = links(nodes)
    roots = connected_components(edges, "simhash")
    found = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low_id", "n", F.coalesce("root", "fp").alias("root"))
    out = written(found, "simhash-rooted")
    drop_written(nodes, edges, roots)
    return out


def components(fingerprinted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, n, component), written: for each distinct fingerprint its rows and the smallest id that it reaches by links."""
    rooted = _rooted(fingerprinted, id_col)
    smallest = rooted.groupBy("root").agg(F.min("low_id").alias("component"), F.count("*").alias("members"))
    found = join_spread(rooted.select("fp", "n", "root"), smallest.select("root", "component"), "root", smallest.select("root", F.col("members").alias("n")))
    out = written(found.select("fp", "n", "component"), "simhash-components")
    drop_written(rooted)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), one row per row of ``df``."""
    prints = written(with_fingerprint(df.select(F.col(id_col).alias("id"), text_of(text).alias("text")), "text", "fp").select("id", "fp"), "simhash-fingerprints")
    found = components(prints, "id")
    joined = join_spread(prints, found.drop("n"), "fp", found.select("fp", "n"))
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, of those the first fingerprint.

    A row goes only if a row of its own group stays, so unrelated texts with the same id all stay, and
    of a group whose ids are all null one row stays too. Only narrow rows (id, fingerprint) are
    compared; whole rows are dealt by their id. Fingerprints are computed again where an id
    has several of them or is null.
    """
    prints = written(with_fingerprint(df.select(F.col(id_col).alias("id"), text_of(text).alias("text")), "text", "fp").select("id", "fp"), "simhash-fingerprints")
    lowest = F.min(F.struct(F.col("low_id").isNull(), "low_id", "fp")).alias("first")
    rooted = _rooted(prints, "id")
    chosen = rooted.groupBy("root").agg(lowest).select(F.col("first.low_id").alias("low"), F.col("first.fp").alias("print"))
    several = prints.where("id is not null").groupBy("id").agg((F.min("fp") != F.max("fp")).alias("several")).where("several")
    survivors = written(chosen.join(several, F.col("low") == F.col("id"), "left").select("low", "print", F.coalesce("several", F.col("low").isNull()).alias("several")), "simhash-survivors")
    drop_written(prints, rooted)
    plain, others = survivors.where("not several"), survivors.where("several")
    rows = rows_of(df, id=F.col(id_col))
    kept = rows.join(plain, F.col("id") == F.col("low"), "left_semi").dropDuplicates(["id"])
    if others.isEmpty():  # each id that stands for a group has one text
        return unpacked(kept)
    unsure = written(rows.where(F.col("id").isNull()).unionByName(rows.join(others, F.col("id") == F.col("low"), "left_semi")), "simhash-unsure")
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    found = with_fingerprint(unsure.withColumn("body", body), "body", "fp").join(others, (F.col("fp") == F.col("print")) & F.col("id").eqNullSafe(F.col("low")), "left_semi")
    return small_batches(unpacked(kept.unionByName(found.dropDuplicates(["id", "fp"]).select("row", "id"))))

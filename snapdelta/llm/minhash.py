"""MinHash fingerprints and near-duplicate classes.

Universal hash permutations over word shingles, in numpy: a word's 64-bit hash is looked up once, a
shingle's hash is a polynomial of its words' hashes, and each permutation is a multiply-add-shift hash
of that; all are evaluated for a chunk of shingles at a time. The fingerprint keeps 16 bits of each
permutation's minimum.

Signature bands are joined in Spark: texts that share a band meet in a list, a list gives a spanning
forest of the pairs whose fingerprints are alike enough to be linked (never all pairs), and the texts
of each cluster so found are held against each other by the exact Jaccard similarity of their shingle
sets. Classes are the components of the verified links, so all that is told of a pair of texts that
meet is exact. Copies are one node from the start. Lists and clusters of any size are cut into parts
that are held against each other two at a time, in tasks of their own.

Words are lower-cased in A-Z and end at ASCII white space. Fewer words than a shingle takes are one
shingle; a text without words has a fingerprint of its own (all bits set), so two of them are alike.

Defined cases: null text is empty. Rows are taken one by one, with null and repeated ids too; ids are
ordered as numbers if they are integers and else as strings, nulls first. A class is named by its
smallest id that isn't null (null if there is none). An empty table has no rows. Other columns of the
table are never looked at, so their names can't clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm.common import drop_written, fixed_numbers, join_spread, text_of, written
from snapdelta.llm.components import connected_components

WIDTH, PERMUTATIONS, BANDS = 5, 64, 16
_CHUNK = 1024
_A = np.array([x | 1 for x in fixed_numbers("minhash factor", PERMUTATIONS)], np.uint64)[:, None]
_B = np.array(fixed_numbers("minhash offset", PERMUTATIONS), np.uint64)[:, None]
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH)]
_NONE = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def digest_of(words: list[bytes]) -> bytes:
    """Tells word sequences apart."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class WordHashes:
    """Hashes of words, with a bounded memory of words seen before."""

    def __init__(self, remember: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, start: int = 0) -> np.ndarray:
    """Hashes of the shingles from word ``start`` on."""
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    out = np.zeros(max(0, n - start), np.uint64)
    for k in range(width):
        out += words[start + k : n + k] * np.uint64(_POWERS[k])
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation."""
    low = _NONE.copy()
    x = hashes >> np.uint64(32)
    for at in range(0, len(x), _CHUNK):
        np.minimum(low, (_A * x[None, at : at + _CHUNK] + _B).min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The 16 bits of each minimum that make the fingerprint."""
    return (low >> np.uint64(32)).astype(np.uint16)


def signature(text: str | None, hashes: WordHashes | None = None) -> np.ndarray:
    return packed(minima(shingles((hashes or WordHashes())(words_of(text)))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with equal keys of a sorted stream, all that end in a batch at once, never cut in two."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        held = rows[last].reset_index(drop=True)
        if not last.all():
            yield rows[~last].reset_index(drop=True)
    if held is not None:
        yield held


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pd.DataFrame:
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"u": np.concatenate([none, *left]), "v": np.concatenate([none, *right])})


def _forest(n: int, alike) -> tuple[list[int], list[int]]:
    """(members, roots) by breadth first search; ``alike(i, rest)`` tells which of ``rest`` are linked to ``i``."""
    members, roots, rest = [], [], np.arange(n)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        front = [root]
        while front and len(rest):
            hit = alike(front.pop(), rest)
            if hit.any():
                reached = rest[hit].tolist()
                front += reached
                members += reached
                roots += [root] * len(reached)
                rest = rest[~hit]
    return members, roots


def _likely(least: int):
    """Spanning forests of a bucket's pairs whose fingerprints agree in ``least`` places or more."""
    keys = ["bucket", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _grouped(batches, keys):
            group = rows.groupby(keys, sort=False).ngroup().to_numpy()
            sizes = np.bincount(group)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sigs = np.frombuffer(b"".join(rows["sig"]), ">u2").reshape(len(rows), -1)
            nid = rows["nid"].to_numpy()
            two = starts[sizes == 2]
            two = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= least]
            left, right = [nid[two + 1]], [nid[two]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = sigs[start : start + size]
                members, roots = _forest(size, lambda i, rest, own=own: (own[rest] == own[i]).sum(axis=1) >= least)
                left.append(nid[start + np.array(members, int)])
                right.append(nid[start + np.array(roots, int)])
            yield _edges(left, right)

    return run


def candidates(nodes: DataFrame, threshold: float, margin: float = 0.25, block: int = 4096) -> DataFrame:
    """(u, v) edges whose components hold all pairs of (nid, sig) that share a band and are nearly ``threshold`` alike.

    The margin is five standard deviations of the estimate. Only entries that aren't alone in their
    bucket are dealt with their fingerprint; a bucket of more than ``block`` of them is cut.
    """
    step = 2 * PERMUTATIONS // BANDS
    band = F.posexplode(F.array(*(F.substring("sig", 1 + step * k, step) for k in range(BANDS)))).alias("band", "key")
    banded = nodes.select("nid", "sig", band).select("nid", F.xxhash64("band", "key").alias("bucket"))
    lists = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "minhash-lists")
    cut = F.when(F.col("n") > block, F.ceil(F.col("n") / (block // 2))).otherwise(1).cast("int")
    met = join_spread(banded, lists.select("bucket", cut.alias("parts")), "bucket", lists)
    dealt = (
        met.join(nodes.select("nid", "sig"), "nid")
        .withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("nid", "sig", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
    )
    least = int(np.ceil((threshold - margin) * PERMUTATIONS))
    edges = written(dealt.mapInPandas(_likely(least), "u long, v long").distinct(), "minhash-candidates")
    drop_written(lists)
    return edges


def _verified(threshold: float):
    """Spanning forests of a cluster's pairs whose shingle sets reach the Jaccard similarity ``threshold``."""
    keys = ["cluster", "low", "high"]

    def jaccard(a: np.ndarray, b: np.ndarray) -> float:
        if min(len(a), len(b)) < threshold * max(len(a), len(b)):
            return 0.0
        if not len(a):
            return 1.0
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for rows in _grouped(batches, keys):
            left, right = [], []
            for _, own in rows.groupby(keys, sort=False):
                sets = [np.unique(shingles(hashes(words_of(t)))) for t in own["text"]]
                members, roots = _forest(len(own), lambda i, rest, sets=sets: np.array([jaccard(sets[i], sets[j]) >= threshold for j in rest]))
                nid = own["nid"].to_numpy()
                left.append(nid[members])
                right.append(nid[roots])
            yield _edges(left, right)

    return run


_SLOTS = 1 << 25


def _texts_of(df: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(digest, text): a text for each digest of ``nodes``.

    A bitmap of fixed size (4 MB) of the digests asked for goes to the tasks, so that other texts aren't
    shuffled; what it lets through by chance goes in the join.
    """
    spark = df.sparkSession
    slot = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % _SLOTS
    marks = nodes.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 AS int)))").alias("bits")).collect()
    bitmap = np.zeros(_SLOTS // 64, np.int64)
    for r in marks:
        bitmap[r["k"]] = r["bits"]
    asked = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        for batch in batches:
            digests, texts = [], []
            for value in batch.column(0):
                own = value.as_py()
                digest = digest_of(words_of(own))
                at = int.from_bytes(digest[:4], "big") % _SLOTS
                if int(wanted[at // 64]) >> at % 64 & 1:
                    digests.append(digest)
                    texts.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.string())], names=["digest", "text"])

    return df.select(text_of(text).alias("text")).mapInArrow(run, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))


def verified(df: DataFrame, text: str, nodes: DataFrame, edges: DataFrame, threshold: float, part_chars: int = 1 << 24) -> DataFrame:
    """(u, v): the links of ``nodes`` (digest, nid, chars) in the clusters that ``edges`` make.

    Clusters of more than ``part_chars`` characters are cut, so a task holds two such parts, or two
    texts where they are longer.
    """
    roots = connected_components(edges, "minhash-clusters")
    clusters = roots.select(F.col("node").alias("nid"), F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("nid"), F.col("root").alias("cluster")).distinct())
    met = written(clusters.join(nodes.select("nid", "digest", "chars"), "nid"), "minhash-met")
    sizes = written(met.groupBy("cluster").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")), "minhash-sizes")
    cut = F.least(F.ceil(F.col("chars") / part_chars), F.col("n")).cast("int")
    placed = join_spread(met.drop("chars"), sizes.select("cluster", F.greatest(cut, F.lit(1)).alias("parts")), "cluster", sizes.select("cluster", "n"))
    dealt = (
        placed.withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
        .join(_texts_of(df, text, met), "digest")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("nid", "text", "cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high", "nid")
    )
    out = written(dealt.mapInPandas(_verified(threshold), "u long, v long").distinct(), "minhash-links")
    drop_written(roots, met, sizes)
    return out


def classes(df: DataFrame, prints: DataFrame, text: str = "text", threshold: float = 0.8, block: int = 4096, part_chars: int = 1 << 24) -> DataFrame:
    """(digest, copies, copy_id, class_id) of every different word sequence; ``prints`` has (id, digest, sig, chars) of the rows of ``df``.

    ``copy_id`` is the smallest id with that word sequence, ``class_id`` the smallest of all that are
    reached by links of ``threshold`` or more.
    """
    named = prints.groupBy("digest", "sig").agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.max("chars").alias("chars"))
    nodes = written(named.withColumn("nid", F.monotonically_increasing_id()), "minhash-nodes")
    edges = candidates(nodes.select("nid", "sig"), threshold, block=block)
    links = verified(df, text, nodes, edges, threshold, part_chars)
    roots = connected_components(links, "minhash-classes")
    rooted = nodes.join(roots, F.col("nid") == F.col("node"), "left").select("digest", "copies", "copy_id", F.coalesce("root", "nid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("n"))
    out = written(join_spread(rooted, least.drop("n"), "root", least.select("root", "n")).drop("root"), "minhash-named")
    drop_written(nodes, edges, links, roots)
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(id, copy_id, class_id), one row per row of ``df``."""
    source = df.select(F.col(id_col).alias("id"), text_of(text).alias("text"))
    schema = T.StructType([source.schema[0], *T.StructType.fromDDL("digest binary, sig binary, chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = []
            for value in batch.column(1):
                own = value.as_py()
                words = words_of(own)
                made.append((digest_of(words), packed(minima(shingles(hashes(words)))).astype(">u2").tobytes(), len(own)))
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True))], names=schema.names)

    prints = written(source.mapInArrow(run, schema), "minhash-prints")
    found = classes(df, prints, text, threshold, **sizes)
    return join_spread(prints.select("id", "digest"), found.drop("copies"), "digest", found.select("digest", F.col("copies").alias("n"))).select(F.col("id").alias(id_col), "copy_id", "class_id")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many characters from the start of ``following`` (or all of it)."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _bounds(rows: DataFrame, blocks: int, n: int, sampled: int) -> list[tuple]:
    """Where blocks begin, as (known, order, tie); from ids alone unless one of them fills more than a block."""
    share = min(1.0, max(sampled, 3 * blocks) / n)
    picked = rows if share == 1.0 else rows.sample(share, seed=11)
    for tie in (F.lit(0).cast("long"), F.xxhash64("text")):
        found = sorted(tuple(r) for r in picked.select("known", "order", tie.alias("tie")).collect())
        cuts = [found[k * len(found) // blocks] for k in range(1, blocks)] if found else []
        if len(set(cuts)) == len(cuts):
            break
    return sorted(set(cuts))


def in_order(df: DataFrame, id_col: str = "doc_id", text: str = "text", block_rows: int = 50_000, least_rows: int = 2000, sampled: int = 200_000) -> DataFrame:
    """(target, guest, id, text): rows dealt into blocks of neighbouring ids, in order, each block
    followed by the first row of the next one (of the first after the last) as a guest.

    Order: id with nulls first, then the text's hash. Blocks hold about ``block_rows`` rows, however
    many there are, and fewer in a small table, which has a block for each of the session's shuffle
    partitions if that leaves ``least_rows`` in each. Their bounds come from a sample of ids; only ids and
    hashes are looked at to find each block's first row, and those, a row a block, are broadcast.
    Texts are dealt once.
    """
    spark = df.sparkSession
    kind = "long" if isinstance(df.schema[id_col].dataType, _INTEGERS) else "string"
    own = F.col(id_col).cast(kind)
    rows = df.select(F.col(id_col).alias("id"), own.isNotNull().alias("known"), F.coalesce(own, F.lit(0 if kind == "long" else "").cast(kind)).alias("order"), text_of(text).alias("text"))
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // least_rows))
    bounds = _bounds(rows, blocks, n, min(sampled, 100 * blocks)) if blocks > 1 else []

    @F.pandas_udf("int")
    def block_of(known: pd.Series, order: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(known.tolist(), order.tolist(), tie.tolist(), strict=True)], index=known.index, dtype="int32")

    placed = rows.withColumn("tie", F.xxhash64("text"))
    placed = placed.withColumn("block", block_of("known", "order", "tie") if bounds else F.lit(0))
    firsts = sorted(placed.groupBy("block").agg(F.min(F.struct("known", "order", "tie")).alias("first")).collect(), key=lambda r: r["block"])
    guest_in = F.lit(None).cast("int")
    if firsts:
        before = [(r["block"], firsts[k - 1]["block"], *r["first"]) for k, r in enumerate(firsts)]
        heads = spark.createDataFrame(before, f"head_block int, previous int, head_known boolean, head_order {kind}, head_tie long")
        placed = placed.join(F.broadcast(heads), F.col("block") == F.col("head_block"), "left")
        is_head = (F.col("known") == F.col("head_known")) & (F.col("order") == F.col("head_order")) & (F.col("tie") == F.col("head_tie"))
        guest_in = F.when(is_head, F.col("previous"))
    targets = F.array_compact(F.array(F.struct(F.col("block").alias("target"), F.lit(0).alias("guest")), F.when(guest_in.isNotNull(), F.struct(guest_in.alias("target"), F.lit(1).alias("guest")))))
    dealt = placed.select("id", "known", "order", "tie", "text", F.explode(targets).alias("t")).select("t.target", "t.guest", "id", "known", "order", "tie", "text")
    return dealt.repartitionById(blocks, F.col("target")).sortWithinPartitions("target", "guest", "known", "order", "tie").select("target", "guest", "id", "text")


OUT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, digest binary"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, digest) of every row.

    A single document follows itself. Two empty texts are alike (1.0).
    """
    ordered = in_order(df, id_col, text, **sizes)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(OUT).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        target, held = None, None  # the row that waits for the one after it: (id, text, words, digest)

        def row(now: tuple, following: tuple) -> tuple:
            key, text, words, digest = now
            other = edited(text, following[1])
            new = hashes(words_of(other))
            n = min(len(words), len(new))
            differ = np.flatnonzero(words[:n] != new[:n])
            same = max(0, (int(differ[0]) if len(differ) else n) - WIDTH + 1)  # shingles that both begin with
            same = same if min(len(words), len(new)) >= WIDTH else 0
            common = minima(shingles(words[: same + WIDTH - 1])) if same else _NONE
            own, their = (packed(np.minimum(common, minima(shingles(w, same)))) for w in (words, new))
            return key, len(text), hashlib.sha256(other.encode()).hexdigest(), own.astype(">u2").tobytes(), their.astype(">u2").tobytes(), likeness(own, their), own, digest

        pending: tuple | None = None  # a finished row that waits for the next row's fingerprint
        for batch in batches:
            done: list[tuple] = []
            for to, guest, key, text in zip(batch["target"].to_pylist(), batch["guest"].to_pylist(), batch["id"], batch["text"], strict=True):
                if to != target:
                    target, held, pending = to, None, None
                elif held is None:
                    continue  # further guests
                text = text.as_py()
                words = words_of(text)
                now = (key.as_py(), text, hashes(words), digest_of(words))
                if held is not None:
                    made = row(held, now)
                    if pending is not None:
                        done.append((*pending[:6], likeness(pending[6], made[6]), pending[7]))
                    pending = made
                held = now
                if guest:
                    done.append((*pending[:6], likeness(pending[6], packed(minima(shingles(now[2])))), pending[7]))
                    held = pending = None
            if done:
                kinds = [batch["id"].type, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)


def edit_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The columns of ``fingerprints`` (in hex) with ``copies``, ``copy_id`` and ``class_id`` of ``classes``, one row per row of ``df``."""
    report = written(fingerprints(df, id_col, text), "minhash-report")
    prints = report.select("id", "digest", F.col("fingerprint").alias("sig"), F.col("n_chars").alias("chars"))
    found = classes(df, prints, text, threshold)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return join_spread(report, found, "digest", found.select("digest", F.col("copies").alias("n"))).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", "copies", "copy_id", "class_id")

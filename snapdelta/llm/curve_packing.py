"""Packing along a space-filling curve.

Each document's four-byte stretches are hashed into a vector of counts, which a fixed random matrix
projects to three dimensions; the Hilbert index of that point is its key. Documents are range-sorted by key, and each
range is tokenised in that order and cut into sequences of ``length`` ids, so neighbours on the
curve share sequences and nothing but the end of a range is left over. That rest is cut into
sequences whose sizes are powers of two, which need no padding.

Bounds of ranges come from a sample of documents, so keys are computed once and whole texts are dealt
out once. Ranges hold about ``range_bytes`` of text however much there is. Ties on the curve (copies)
are told apart by a hash of id and text, so a group of copies of any size spreads over ranges. A range
is read as a stream.

Defined cases: null text is empty, a document of the end id alone. Rows with null or repeated ids, and
repeated rows, are documents of their own; ids may have any type. Texts of any length are cut over
sequences. Only the id and the text are looked at, so names of other columns can't clash. An empty
table has no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm.common import fixed_numbers, own_job, quiet_threads, small_batches, text_of

DIMENSIONS, BITS, HASHED = 3, 16, 1 << 12
SPREAD = 0.5  # projections of vectors of shares lie well inside -SPREAD..SPREAD
_RANGE = 40  # bits of a sequence id below the range's number
_TIES = 15


@functools.lru_cache(maxsize=1)
def _matrix() -> np.ndarray:
    """Signs, which depend on nothing but this line."""
    return np.array([[1.0 if x >> d & 1 else -1.0 for d in range(DIMENSIONS)] for x in fixed_numbers("curve", HASHED)], np.float32)


def project(text: str) -> np.ndarray:
    """The point of a text, as unsigned coordinates: its hashed vector, scaled to shares, times the matrix."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < 4:
        return np.zeros(DIMENSIONS, np.int64)
    counts = np.zeros(HASHED)
    for start in range(0, len(raw) - 3, 1 << 20):
        part = raw[start : start + (1 << 20) + 3].astype(np.uint32)
        grams = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=HASHED)
    scaled = (counts @ _matrix() / (len(raw) - 3) + SPREAD) / (2 * SPREAD) * (1 << BITS)
    return np.clip(scaled, 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row (Skilling's transpose form, then the bits interleaved)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_order(text: Column, tie: Column) -> Column:
    """The Hilbert key of a text, with 15 bits of ``tie`` below it."""

    @F.pandas_udf("long")
    def run(texts: pd.Series, ties: pd.Series) -> pd.Series:
        key = hilbert(np.array([project(t) for t in texts], np.int64).reshape(-1, DIMENSIONS))
        return pd.Series(key << _TIES | ties.to_numpy() & ((1 << _TIES) - 1), index=texts.index)

    return run(text, tie)


def range_bounds(rows: DataFrame, range_bytes: int, least_bytes: int, sampled: int, each: int = 100) -> tuple[list[int], int]:
    """(bounds, ranges) for rows of (text, tie), from a sample of about ``sampled`` rows, or ``each`` a range if that is more."""
    n = rows.count()
    for wanted in (sampled, None):
        share = min(1.0, (wanted or each * ranges) / max(1, n))  # noqa: F821  the second time the first sample has told
        picked = rows if share == 1.0 else rows.sample(share, seed=17)
        with own_job(rows.sparkSession):
            seen = picked.select(curve_order(F.col("text"), F.col("tie")).alias("o"), F.octet_length("text").alias("b")).collect()
        whole = sum(r["b"] + 1 for r in seen) / share
        least = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(whole // least_bytes))
        ranges = max(1, least, int(-(-whole // range_bytes)))
        if share == 1.0 or each * ranges <= 2 * sampled:
            break
    found = sorted(r["o"] for r in seen)
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)} if found else ()), ranges


#: A tokenizer of this make treats the stretches between white space apart from each other.
SEPARABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: White space and A-Z as that normalizer takes them, for texts of Latin-1 characters only.
_TABLE = bytes(0x20 if c in (9, 10, 11, 12, 13, 0x85, 0xA0) else ord(chr(c).lower()) for c in range(256))
_MARKS = tuple(bytes([c]) for c in b".,;:!?")


class Tokens:
    """Ids of a text as little-endian 32-bit bytes, with a bounded memory of stretches seen before."""

    def __init__(self, path: str, remember: int = 450_000):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [t["content"] for t in made["added_tokens"]]
        self.separable = all(made[k] == v for k, v in SEPARABLE.items()) and made["post_processor"] is None
        vocabulary, suffix = self.tool.get_vocab(), made["model"].get("end_of_word_suffix") or "\0"
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.remember = remember

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.separable or any(t in text for t in self.added):
            return self.whole(text)
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        stretches = plain.translate(_TABLE).split(b" ")
        known = self.known
        if new := set(stretches).difference(known):
            if len(known) + len(new) > self.remember:
                known.clear()
                new = set(stretches)
            # letters and one mark after them are never merged, so such a stretch is put together from its parts
            joined = [s for s in new if s[-1:] in _MARKS and s[:-1].decode("latin-1").isalpha()]
            bare = new.difference(joined)
            bare.update(s[:-1] for s in joined if s[:-1] not in known)
            bare.update(s[-1:] for s in joined if s[-1:] not in known)
            self._learn(bare)
            for s in joined:
                known[s] = known[s[:-1]] + known[s[-1:]]
        return b"".join(map(known.__getitem__, stretches))

    def _learn(self, stretches: set[bytes], at_once: int = 4096) -> None:
        """Words of letters are tokenised as one text and told apart by the ids that end a word; other stretches one by one."""
        letters = [s for s in stretches if s.decode("latin-1").isalpha()]
        others = list(stretches.difference(letters))
        for start in range(0, len(letters), at_once):
            words = letters[start : start + at_once]
            ids = np.array(self.tool.encode_batch_fast([b" ".join(words).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(words):
                others += words
                continue
            raw = ids.tobytes()
            self.known.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))
        for s, e in zip(others, self.tool.encode_batch_fast([s.decode("latin-1") for s in others], add_special_tokens=False), strict=True):
            self.known[s] = np.array(e.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers(rest: int) -> list[int]:
    """``rest`` as powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, with_ids: bool = False, range_bytes: int = 256 << 20, least_bytes: int = 8 << 20, sampled: int = 5000) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    ``with_ids`` adds the piece's ids. ``sequence_id`` is the range's number above 40 bits and the
    sequence's number in its range below. A range holds about ``range_bytes`` of text; less in a small
    table, which has a range for each of the session's shuffle partitions if that leaves
    ``least_bytes`` in each.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text).alias("text")).withColumn("tie", F.xxhash64("id", "text"))
    bounds, ranges = range_bounds(rows.select("text", "tie"), range_bytes, least_bytes, sampled)
    limits = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(orders: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, orders.to_numpy(), side="right").astype(np.int32), index=orders.index)

    placed = rows.withColumn("order", curve_order(F.col("text"), F.col("tie"))).withColumn("target", range_of("order"))
    ordered = placed.repartitionById(ranges, F.col("target")).sortWithinPartitions("target", "order", "tie").select("target", "id", "text")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL(SCHEMA + (", ids array<int>" if with_ids else "")).fields])
    crc = zlib.crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        id_type, target, sequence, offset = None, None, 0, 0
        open_: list[tuple] = []  # pieces of the sequence that isn't full yet, with their bytes

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*(p[:7] for p in pieces), strict=True))
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p[7], "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def rest() -> list[tuple]:
            """The end of a range, cut again at powers of two."""
            cuts, sizes, room, number = [], powers(offset), 0, sequence
            for key, start, n, _, total, _, _, part in open_:
                at = 0
                while at < n:
                    if not room:
                        size = room = sizes.pop(0)
                        number += bool(cuts)
                    m = min(room, n - at)
                    cut = part[4 * at : 4 * (at + m)]
                    cuts.append((key, start + at, m, crc(cut), total, number, size - room, cut))
                    at, room = at + m, room - m
            return cuts

        for batch in batches:
            done: list[tuple] = []
            id_type = batch.column(1).type
            for to, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if to != target:
                    done += rest()
                    open_, target, sequence, offset = [], to, to << _RANGE, 0
                ids = tool(value.as_py()) + end
                total, start = len(ids) // 4, 0
                while start < total:
                    n = min(length - offset, total - start)
                    part = ids[4 * start : 4 * (start + n)]
                    open_.append((key, start, n, crc(part), total, sequence, offset, part))
                    start, offset = start + n, offset + n
                    if offset == length:
                        done += open_
                        open_, sequence, offset = [], sequence + 1, 0
            if done:
                yield out(done)
        if open_:
            yield out(rest())
        pa.default_memory_pool().release_unused()  # the worker lives on for tasks of other kinds

    return small_batches(ordered.mapInArrow(run, schema))

"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised here, by longest-prefix matching in the model's compiled character map (a
double-array trie), and every normalised byte remembers the source byte it came from. The library
then only segments the normalised text (with a copy of the model whose own normaliser is switched
off), and each piece is projected to its byte span in the source through the recorded alignment.

Spans are byte offsets into the UTF-8 source; a byte-fallback piece other than the last of its
character has an empty span.

Defined cases: null text counts as empty: no piece but the end id. Texts of any length are encoded
whole, and text that reads like a control piece ("<s>") is text. Rows are encoded one by one, with null and
repeated ids too, and what ``keep`` names stays beside them as it is; a kept column named like an
output is an error that says so. An empty table has no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm.common import small_batches

_SPACE, _MARK = 0x20, "▁".encode()
_USER_DEFINED = 4


class CharMap:
    """The compiled character map: trie size (uint32), double-array units (uint32), then the
    NUL-ended replacements that the trie's values point into."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.replacements = blob[4 + size :]
        self.first = np.zeros(256, bool)
        if self.units:
            for byte in range(1, 256):
                self.first[byte] = self._step(self._offset(self.units[0]), byte) is not None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The node below ``node`` (a position before its offset is applied) by ``byte``."""
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & ((1 << 31) | 0xFF) != byte:
            return None
        return at

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``start`` and its replacement."""
        node, found = self._offset(self.units[0]), None
        for i in range(start, len(text)):
            at = self._step(node, text[i])
            if at is None:
                break
            unit = self.units[at]
            node = at ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & ((1 << 31) - 1)
                found = i + 1 - start, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(model_path, "rb") as f:
            blob = f.read()
        model = proto.ModelProto.FromString(blob)
        spec, pieces = model.normalizer_spec, model.pieces
        self.prefix, self.collapse = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape, self.suffix = spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap(spec.precompiled_charsmap)
        self.symbols = sorted((p.piece.encode() for p in pieces if p.type == _USER_DEFINED), key=len, reverse=True)
        self.first = self.map.first.copy()
        for s in self.symbols:
            self.first[s[0]] = True
        self.full = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # A byte piece <0xNN> stands for one normalised byte.
        self.lengths = np.array([1 if self.full.is_byte(i) else len(p.piece.encode()) for i, p in enumerate(pieces)], np.int64)
        self.unknown, self.end = self.full.unk_id(), self.full.eos_id()
        self.names = [str(i) for i in range(len(pieces))]

    def _units(self, source: bytes, raw: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(start, length, replacement) of each match, left to right, longest first."""
        out, free = [], 0
        if not self.first.any():
            return out
        for at in np.flatnonzero(self.first[raw]).tolist():
            if at < free:
                continue
            symbol = next((s for s in self.symbols if source.startswith(s, at)), None)
            match = (len(symbol), symbol) if symbol else self.map.longest(source, at) if self.map.units else None
            if match:
                out.append((at, *match))
                free = at + match[0]
        return out

    @staticmethod
    def _begin(source: bytes, units: list[tuple[int, int, bytes]]) -> int:
        """Where the text begins after spaces, and after what the map makes into one space."""
        at, rest = 0, iter(units)
        unit = next(rest, None)
        while at < len(source):
            if unit and unit[0] == at:
                if unit[2] != b" ":
                    break
                at += unit[1]
                unit = next(rest, None)
            elif source[at] == _SPACE:
                at += 1
            else:
                break
        return at

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte where it begins."""
        source = text.encode()
        raw = np.frombuffer(source, np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        origin = np.repeat(starts, np.diff(starts, append=len(raw)))  # a character's bytes share its start
        heading = np.ones(len(raw), bool)
        units = self._units(source, raw)
        if units:
            bytes_, origins, heads, done = [], [], [], 0
            for at, length, new in units:
                fresh = np.frombuffer(new, np.uint8)
                bytes_ += [raw[done:at], fresh]
                origins += [origin[done:at], np.full(len(fresh), at)]
                heads += [heading[done:at], np.arange(len(fresh)) < len(new) - len(new.lstrip(b" "))]
                done = at + length
            raw = np.concatenate([*bytes_, raw[done:]])
            origin = np.concatenate([*origins, origin[done:]])
            heading = np.concatenate([*heads, heading[done:]])
        last = len(source)
        if self.collapse:
            space = raw == _SPACE
            after_space = np.concatenate([[True], space[:-1]])[: len(raw)]
            keep = ~(space & heading & after_space)
            raw, origin = raw[keep], origin[keep]
            end = len(raw)
            while end:
                # the library tells spaces at the end by how they are written in the end, so a literal mark counts
                if raw[end - 1] == _SPACE:
                    end -= 1
                elif self.escape and raw[end - 3 : end].tobytes() == _MARK:
                    end -= 3
                else:
                    break
                last = int(origin[end])
            raw, origin = raw[:end], origin[:end]
        if not len(raw) and (self.collapse or not source):
            return b"", np.array([last], np.int64)
        ahead = self.prefix and not self.suffix
        behind = self.prefix and self.suffix
        raw = np.concatenate([[_SPACE] * ahead, raw, [_SPACE] * behind]).astype(np.uint8)
        first = self._begin(source, units) if self.collapse else 0
        origin = np.concatenate([[first] * ahead, origin, [last] * behind, [last]]).astype(np.int64)
        if self.escape and (space := raw == _SPACE).any():
            # spaces that the dummy prefix or the source brought become three-byte marks
            origin = np.concatenate([np.repeat(origin[:-1], np.where(space, 3, 1)), origin[-1:]])
            return raw.tobytes().replace(b" ", _MARK), origin
        return raw.tobytes(), origin

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids (without the end id) and the source byte span of each."""
        plain, origin = self.normalise(text)
        normalised = plain.decode("utf-8", "replace")
        ids = self.segmenter.encode(normalised)
        if not ids:
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = self.lengths[ids]
        if self.unknown in ids:
            lengths = np.array([len(p.encode()) for p in self.segmenter.encode(normalised, out_type=str)])
        ends = np.cumsum(lengths)
        return ids, origin[ends - lengths], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids)


@functools.lru_cache(maxsize=4)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


#: What ``transcode`` can emit for a text.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "begins": T.ArrayType(T.IntegerType()),
    "ends": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "covered_bytes": T.LongType(),
}


def transcode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, emit: tuple[str, ...] = ("ids", "begins", "ends", "decoded"), end_id: bool = True) -> DataFrame:
    """Encodes ``text`` with spans, decodes the ids again, and emits the asked columns beside ``keep``.

    ``ids`` includes the end id if asked for; ``begins`` and ``ends`` have an entry for each other
    piece. ``covered_bytes`` counts the source bytes inside spans, so it equals the text's length
    in UTF-8 where normalisation drops nothing. Digest outputs are those of ``ids`` and ``decoded``.
    One narrow pass: nothing is shuffled, and only the text and ``keep`` reach Python.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if clash := set(keep) & set(emit):
        raise ValueError(f"columns {sorted(clash)} are outputs of transcode; rename them first")
    source = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(c, OUTPUTS[c]) for c in emit)])
    digests = {"ids_sha256", "decoded_sha256", "decoded"} & set(emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in emit}
            for value in batch.column(len(keep)):
                ids, begins, ends = tool.encode(value.as_py() or "")
                if end_id:
                    ids.append(tool.end)
                decoded = tool.decode(ids) if digests - {"ids_sha256"} else ""
                made = {"ids": ids, "begins": begins, "ends": ends, "decoded": decoded, "n_tokens": len(ids), "covered_bytes": int((ends - begins).sum())}
                if "ids_sha256" in rows:
                    made["ids_sha256"] = hashlib.sha256(" ".join(map(tool.names.__getitem__, ids)).encode()).hexdigest()
                if "decoded_sha256" in rows:
                    made["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
                for c in emit:
                    rows[c].append(made[c])
            kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[c], kinds[OUTPUTS[c]]) for c in emit)], names=schema.names)

    return small_batches(source.mapInArrow(run, schema))


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that ``ids`` decode to; null ids decode to null."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        tool = codec(model_path)
        return column.map(lambda x: None if x is None else tool.decode([int(i) for i in x]))

    return small_batches(df.withColumn(into, run(df[ids])))

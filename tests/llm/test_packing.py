import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from snapdelta.llm import curve_packing as K
from tests.llm.conftest import AWKWARD, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_separate_stretches_give_the_same_ids(library):
    tool = K.Tokens(PATH, remember=8)
    assert tool.separable
    for text in [t or "" for t in AWKWARD] + [f"a{chr(c)}b {chr(c)}S" for c in range(256)] + ["I'LL 's'T ÀÉ µß 12³"]:
        assert np.frombuffer(tool(text), "<u4").tolist() == ids_of(library, text), text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=st.characters(max_codepoint=255), max_size=40))
def test_any_text(text):
    assert np.frombuffer(K.tokens(PATH)(text), "<u4").tolist() == ids_of(Tokenizer.from_file(PATH) if False else K.tokens(PATH).tool, text)


def test_hilbert_curve_is_a_walk():
    for n, bits in ((2, 3), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        key = K.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(1 << n * bits))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_point(text):
    """A stretch and a dimension at a time, in Python's own numbers."""
    import xxhash

    raw = (text or "").encode()
    if len(raw) < 4:
        return [0, 0, 0]
    sums = [0, 0, 0]
    for i in range(len(raw) - 3):
        bin_ = (int.from_bytes(raw[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 20
        signs = xxhash.xxh64_intdigest(f"curve {bin_}".encode())
        sums = [s + (1 if signs >> d & 1 else -1) for d, s in enumerate(sums)]
    return [min(65535, max(0, int((s / (len(raw) - 3) + 0.5) * 65536))) for s in sums]


def plain_hilbert(point, bits=16):
    """Gray-code form of the curve (as in test_hilbert_curve_is_a_walk), by walking down the cubes."""
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(3):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    x[1] ^= x[0]
    x[2] ^= x[1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[2] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(x[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(3)), 2)


def test_keys_equal_brute_force(spark, docs):
    rows = docs.where("length(text) < 3000 or text is null").select(K.text_of().alias("t")).select("t", K.curve_order(K.F.col("t"), K.F.lit(0).cast("long")).alias("o")).collect()
    for r in rows:
        point, plain = K.project(r.t).tolist(), plain_point(r.t)
        assert max(abs(a - b) for a, b in zip(point, plain)) <= 1  # rounding
        assert r.o >> 15 == plain_hilbert(point)


@pytest.mark.parametrize("ranges", [{}, {"range_bytes": 2000, "sampled": 10}, {"least_bytes": 500}])
def test_pieces(spark, docs, library, ranges):
    got = K.pack(docs, PATH, length=64, with_ids=True, **ranges).collect()
    assert len({r.sequence_id >> 40 for r in got}) > 20 if "range_bytes" in ranges else len({r.sequence_id >> 40 for r in got}) <= 4
    want = sorted((str(r.doc_id), *ids_of(library, r.text), 1) for r in docs.collect())
    by_doc: dict = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    rebuilt = []
    for (doc, total), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        copies = sum(r.length for r in pieces) // total
        if copies == 1:
            at = 0
            for r in pieces:
                assert r.start == at
                at += r.length
            rebuilt.append((str(doc), *(i for r in pieces for i in r.ids)))
        else:
            assert sum(r.length for r in pieces) == copies * total
            rebuilt += [w for w in want if w[0] == str(doc) and len(w) - 1 == total]
    assert sorted(rebuilt) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0  # nothing is padded
    assert K.pack(docs.limit(0), PATH).count() == 0


def test_neighbours_on_the_curve_share_sequences(spark):
    rows = [(k * 100 + i, prose(120, k) + f" extra{i}") for k in range(6) for i in range(20)]
    got = K.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()
    topics: dict = {}
    for r in got:
        topics.setdefault(r.sequence_id, []).append(r.doc_id // 100)
    assert np.mean([len(set(v)) for v in topics.values()]) <= 2.5


def test_powers():
    assert all(sum(K.powers(n)) == n for n in range(300)) and K.powers(0) == []


@pytest.mark.parametrize("kind", ["int", "string", "smallint", "decimal(12,0)"])
def test_ids_of_other_types(spark, docs, kind):
    own = docs.where("doc_id < 130 or doc_id is null").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    got = K.pack(own, PATH)
    assert got.schema["doc_id"].dataType == own.schema["doc_id"].dataType
    assert {str(r.doc_id) for r in got.collect()} == {str(r.doc_id) for r in own.collect()}


def test_a_group_of_copies_spreads(spark):
    own = spark.range(400).selectExpr("id AS doc_id", f"'{prose(60, 1)}' AS text")
    got = K.pack(own, PATH, range_bytes=8000, sampled=200).collect()
    sizes: dict = {}
    for r in got:
        sizes[r.sequence_id >> 40] = sizes.get(r.sequence_id >> 40, 0) + r.length
    assert len(sizes) >= 10 and max(sizes.values()) <= 0.3 * sum(sizes.values())

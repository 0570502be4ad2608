import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from snapdelta.llm import sentencepiece_codec as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  two  spaces ", "Été à Köln\n\tœuvre 漢字 🙂 x", "▁literal", "\0nul", "ab" * 3000, "the of <s> </s> <unk> <0x41>"]


def library(text):
    tool = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return tool, tool.encode(text)


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_spans_as_the_library(text):
    tool, ids = library(text)
    got, begins, ends = S.codec(MODEL).encode(text)
    assert got == ids
    spans = tool.encode(text, return_type="proto").pieces
    raw = text.encode()
    for piece, b, e in zip(spans, begins, ends, strict=True):
        assert raw[b:e].decode() == piece.surface
    assert S.codec(MODEL).decode(ids) == tool.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    _, ids = library(text)
    got, begins, ends = S.codec(MODEL).encode(text)
    assert got == ids
    assert int((ends - begins).sum()) == len(text.encode())
    assert (begins[1:] == ends[:-1]).all()


def trie(keys):
    """A tiny double array for keys of one or two bytes, laid out by hand."""
    size = 4096
    units, used, blob = [0] * size, {0}, b""
    children = {}
    for key, value in keys.items():
        children.setdefault(key[0], {})[key[1:]] = value
    base = 512
    units[0] = base << 10
    for first, rest in children.items():
        at = base ^ first
        below = 1024 + 512 * len(used)
        used.add(at)
        units[at] = ((at ^ below) << 10) | first | (256 if b"" in rest else 0)
        for tail, value in rest.items():
            start = len(blob)
            blob += value + b"\0"
            if not tail:
                units[below] = start | 1 << 31
                continue
            leaf = below ^ tail[0]
            end = 3072 + 16 * len(blob)
            units[leaf] = ((leaf ^ end) << 10) | tail[0] | 256
            units[end] = start | 1 << 31
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *units) + blob


def test_longest_prefix_wins_and_keeps_its_source():
    tool = S.Codec(MODEL)
    tool.map = S.CharMap(trie({b"A": b"x", b"AB": b"yz", b"C": b" "}))
    tool.first = tool.map.first
    tool.prefix = tool.escape = False
    plain, origin = tool.normalise("qABAéC")
    assert plain == "qyzxé ".encode()
    assert origin.tolist() == [0, 1, 1, 3, 4, 4, 6, 7]
    tool.collapse = True
    plain, origin = tool.normalise("CC aC b C")
    assert plain == b"a b"
    assert origin.tolist() == [3, 4, 6, 7]


def test_transcode(spark):
    rows = [(i, t, "k") for i, t in enumerate([*TEXTS, None, "twice", "twice"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    out = {r.doc_id: r for r in S.transcode(df, MODEL, emit=("ids", "begins", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    tool = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text, extra in rows:
        ids = tool.encode(text or "", add_eos=True)
        assert out[i].extra == extra and out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded == tool.decode(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert len(out[i].begins) == len(ids) - 1
    back = S.decode(S.transcode(df, MODEL, keep=["doc_id"], emit=("ids",)), MODEL)
    assert {r.doc_id: r.decoded for r in back.collect()} == {k: v.decoded for k, v in out.items()}
    assert S.transcode(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        S.transcode(df.withColumnRenamed("extra", "ids"), MODEL)


def test_empty_normalised_text():
    assert S.codec(MODEL).normalise("")[1].tolist() == [0]
    assert np.array_equal(S.codec(MODEL).encode("")[1], [])


WIDE = ["ＫＡＤＯＫＡＷＡ　ＡＢＣ ①② ﬁ ㍿ Ｈ", "e\u0301 A\u030a \u1e9b\u0323 ½ ²", "ｶﾞｷﾞ ﷺ Ǆ ﬀﬃ", "tab\tnl\n\u200b\ufeff x\u00a0y", "STRASSE ẞ İ ǅ", "\u0344 a\u0344b 각 각"]


@pytest.fixture(scope="module", params=[(rule, collapse) for rule in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf") for collapse in (True, False)], ids=str)
def mapped(request, tmp_path_factory):
    """The public model with the library's own compiled character map of a rule; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    rule, collapse = request.param
    made = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    with open(MODEL, "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = collapse
    path = str(tmp_path_factory.mktemp("map") / f"{rule}-{collapse}.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def agree(mapped, text):
    path, tool = mapped
    got, begins, ends = S.codec(path).encode(text)
    want = tool.encode(text, return_type="proto").pieces
    assert got == [p.id for p in want], text
    raw = text.encode()
    assert [raw[b:e].decode() for b, e in zip(begins, ends, strict=True)] == [p.surface for p in want], text
    assert S.codec(path).normalise(text)[0].decode() == tool.normalize(text), text


@pytest.mark.parametrize("text", WIDE + TEXTS[:7])
def test_real_character_maps(mapped, text):
    assert len(S.codec(mapped[0]).map.units) > 10_000
    agree(mapped, text)


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ａＢ①ﬁ é\u0301\u030a Ａ　½ｶﾞ각 \t\nßİ x"), max_size=30) | st.text(max_size=30))
def test_any_text_under_a_real_map(mapped, text):
    agree(mapped, text)

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from snapdelta.llm import minhash as M
from tests.llm.conftest import prose


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_signature(text):
    """By the definition, a shingle and a permutation at a time, in Python's own integers."""
    words, mask = [xxhash.xxh64(w.encode()).intdigest() for w in plain_words(text)], (1 << 64) - 1
    width = min(5, len(words))
    made = set()
    for i in range(len(words) - width + 1 if words else 0):
        x = sum(words[i + k] * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(width)) & mask
        made.add(((x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask) >> 32)
    factors = [xxhash.xxh64(f"minhash factor {k}".encode()).intdigest() | 1 for k in range(64)]
    offsets = [xxhash.xxh64(f"minhash offset {k}".encode()).intdigest() for k in range(64)]
    return [(min((a * x + b & mask for x in made), default=mask) >> 32) & 0xFFFF for a, b in zip(factors, offsets)]


def hexed(signature):
    return "".join(f"{x:04x}" for x in signature)


def brute(rows, key):
    rows = sorted(rows, key=key)
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        other = text[: len(text) - q] + after[:q]
        a, b, c = map(plain_signature, (text, other, after))
        share = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), hexed(a), hexed(b), share(a, b), share(a, c)))
    return out


def report(df, **sizes):
    return [(r.id, r.n_chars, r.edited_sha256, r.fingerprint.hex(), r.edited_fingerprint.hex(), r.near_edited, r.near_next) for r in M.fingerprints(df, **sizes).collect()]


@pytest.mark.parametrize("rows", [3, 7, 10**6])
def test_report_equals_brute_force(docs, rows):
    """Against a MinHash that shares nothing with the module's but its constants."""
    own = docs.where("doc_id is not null and doc_id <> 999").select("doc_id", "text", "kept").dropDuplicates(["doc_id"])
    assert sorted(report(own, block_rows=rows, least_rows=rows)) == brute([(r.doc_id, r.text) for r in own.collect()], lambda r: r[0])


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_ids_of_other_types(docs, kind):
    own = docs.where("doc_id is not null and doc_id <> 999").dropDuplicates(["doc_id"]).selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    got = report(own, block_rows=9, least_rows=9)
    assert sorted(got, key=str) == sorted(brute([(r.doc_id, r.text) for r in own.collect()], lambda r: r[0] if kind == "int" else str(r[0])), key=str)
    assert M.edit_report(own).schema["class_id"].dataType == own.schema["doc_id"].dataType


def test_one_id_in_many_blocks(spark):
    own = spark.createDataFrame([(1, prose(30, k)) for k in range(60)] + [(None, prose(30, 99 + k)) for k in range(60)], "doc_id long, text string")
    targets = M.in_order(own, block_rows=10, least_rows=10).where("guest = 0").groupBy("target").count().collect()
    assert len(targets) >= 8 and sum(r["count"] for r in targets) == 120
    assert len(report(own, block_rows=10, least_rows=10)) == 120


def test_awkward_rows(spark, docs):
    got = M.edit_report(docs)
    assert got.count() == docs.count()
    assert M.edit_report(docs.limit(0)).count() == 0
    alone = M.edit_report(docs.where("doc_id = 999")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].class_id == 999
    same = {}
    for r in docs.select("doc_id", "text").join(got.withColumnRenamed("doc_id", "i"), docs.doc_id.eqNullSafe(M.F.col("i"))).where("doc_id is not null").collect():
        same.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_likeness_estimates_jaccard():
    for seed in range(5):
        a = prose(800, seed)
        b = a[: len(a) * 3 // 4] + prose(200, seed + 50)
        x, y = (grams(t) for t in (a, b))
        assert abs(M.likeness(M.signature(a), M.signature(b)) - len(x & y) / len(x | y)) < 0.2
    assert M.likeness(M.signature(""), M.signature(None)) == 1.0
    assert M.likeness(M.signature(prose(300, 1)), M.signature(prose(300, 2))) < 0.1


def test_shingles():
    hashes = M.WordHashes()
    w = hashes(b"a b c d e f g".split())
    assert len(M.shingles(w)) == 3 and (M.shingles(w, 1) == M.shingles(w)[1:]).all() and len(M.shingles(w, 9)) == 0
    assert len(M.shingles(hashes([b"a", b"b"]))) == 1 and len(np.unique(M.shingles(hashes([b"x"] * 20)))) == 1


def grams(text):
    words = plain_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """copy and class of each id, by all pairs."""
    first = {}
    for i in sorted(texts):
        first.setdefault(tuple(plain_words(texts[i])), i)
    sets = {i: grams(texts[i]) for i in first.values()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    copy = {i: first[tuple(plain_words(t))] for i, t in texts.items()}
    return {i: (c, find(c)) for i, c in copy.items()}


@pytest.mark.parametrize(("block", "part_chars"), [(4, 600), (4096, 1 << 24)])
def test_classes_equal_brute_force(spark, block, part_chars):
    """With a group of near texts whose lists and clusters are cut, or not."""
    texts = {}
    for k in range(12):
        base = prose(200, k).split()
        for j, cut in enumerate((0, 4, 10, 40)):
            texts[k * 10 + j] = " ".join(base[cut:])
    crowd = prose(150, 77)
    texts |= {300 + k: f"{crowd} tail{k}" for k in range(25)}
    texts |= {400 + k: " ".join(prose(160, 78).split()[k:]) for k in range(0, 90, 6)}  # a chain: only neighbours are linked
    texts |= {200: texts[0].upper(), 201: texts[0] + " ", 202: "", 203: None, 204: " \n"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[0], "x"), (0, texts[0], "y")], "doc_id long, text string, sig string")
    got = [(r.doc_id, (r.copy_id, r.class_id)) for r in M.near_duplicates(df, block=block, part_chars=part_chars).collect()]
    assert len(got) == len(texts) + 2
    want = brute_classes(texts)
    assert len({c for _, c in want.values()}) < len(want) / 2
    assert sorted((x for x in got if x[0] is not None)) == sorted([*want.items(), (0, want[0])])
    assert (None, want[0]) in got


def test_different_texts_with_the_same_or_no_id(spark):
    a, b = prose(100, 1), prose(100, 2)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, b + " z"), (None, prose(90, 5))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.copy_id, r.class_id) for r in M.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (None, None, 1), (None, None, None)], key=str)


def test_recall_on_documents(spark):
    """Every row whose id is divisible by 100, against all rows, by exact sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in M.edit_report(docs).collect()}
    sets = {i: grams(t) for i, t in texts.items()}
    links = [(q, i) for q in sets if q % 100 == 0 for i in sets if i != q and sets[q] and len(sets[q] & sets[i]) >= 0.8 * len(sets[q] | sets[i])]
    assert links and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)

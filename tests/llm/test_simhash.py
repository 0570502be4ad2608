import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from snapdelta.llm import simhash_dedup as H
from snapdelta.llm.components import connected_components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """id -> smallest id reachable, by all pairs."""
    ids = list(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in ids}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abÀé \n\t\x0b AB", max_size=80))
def test_fingerprint(text):
    assert H.fingerprint(text) == plain_fingerprint(text)


def test_quadruples_miss_no_three_positions():
    assert len(H.POSITIONS) == 14
    for spoilt in combinations(range(8), 3):
        assert any(not set(q) & set(spoilt) for q in H.POSITIONS)


def cloud(n, seed=0):
    """Fingerprints in chains and clouds, where three bits decide."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_components_equal_brute_force(spark, block):
    prints = dict(enumerate(cloud(500)))
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    nodes = df.groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "low_id")
    roots = {r.node: r.root for r in connected_components(H.links(nodes, block)).collect()}
    label = {i: roots.get(f, f) for i, f in rows}
    low = {}
    for i, x in label.items():
        low.setdefault(x, i)
    assert {i: low[x] for i, x in label.items()} == brute_components(prints)


def test_long_list_equals_short_lists():
    fps = np.array(sorted(set(cloud(300, 3))), np.uint64)
    def groups(u, v):
        up = {int(f): int(f) for f in fps}
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in zip(u.tolist(), v.tolist()):
            x, y = sorted((find(a), find(b)))
            up[y] = x
        return {f: find(f) for f in up}
    short = H._small_lists(np.zeros(len(fps), int), fps)
    assert groups(*short) == groups(*H._large_list(fps))
    frames = [pd.DataFrame({"key": 1, "low": 0, "high": 0, "fp": part.view(np.int64)}) for part in np.array_split(fps, 7)]
    got = pd.concat(H._forest(iter(frames)))
    assert groups(got.u.to_numpy().view(np.uint64), got.v.to_numpy().view(np.uint64)) == groups(*short)


def test_near_duplicates_on_documents(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 5
    rows = [(5, text), (3, text), (9, text + "x"), (1, None), (2, " \n"), (4, "other words here now"), (7, "Other WORDS here now"), (None, text), (None, None), (3, text), (8, "short")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = H.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == min(i for i in want if want[i] == want[r.doc_id])
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 3]
    kept = H.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(i for i in want if want[i] == w) for w in want.values()})
    empty = H.near_duplicates(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "fingerprint", "component_id"]
    assert H.keep_one_per_group(df.where("doc_id is null")).count() == 2


def test_a_row_goes_only_if_one_of_its_group_stays(spark):
    a, b, c, d = (prose(120, k) for k in (61, 62, 63, 64))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (4, c), (None, d), (None, b)]
    rows += [(None, prose(120, 65)), (None, prose(120, 65)), (None, prose(120, 66))]
    kept = [tuple(r) for r in H.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, a), (2, b), (3, c), (3, d), (None, prose(120, 65)), (None, prose(120, 66))]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_null_ids_leave_one_a_group(spark):
    def near(text):
        others = (text[:k] + "~" + text[k + 1 :] for k in range(1, len(text)))
        return next(t for t in others if 0 < bin(H.fingerprint(text) ^ H.fingerprint(t)).count("1") <= H.MAX_BITS)

    text = prose(300, 71)
    df = spark.createDataFrame([(None, text), (None, near(text))], "doc_id long, text string")
    assert H.keep_one_per_group(df).count() == 1


def test_component_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_the_count_filter_loses_no_link():
    """Every pair within three bits shares five entries; the filter spares pairs that share four alone."""
    fps = np.array(cloud(400, 9), np.uint64)
    a, b = (x.ravel() for x in np.meshgrid(fps, fps))
    plain = np.array([sum(x >> 8 * k & 255 == y >> 8 * k & 255 for k in range(8)) for x, y in zip(a.tolist()[:5000], b.tolist()[:5000])])
    assert (H.tally(a, b)[:5000] == plain).all()
    near = np.array([(x ^ y).bit_count() <= 3 for x, y in zip(a.tolist(), b.tolist())])
    assert (H.linked(a, b) == near).all() and (H.tally(a, b)[near] >= 5).all() and (H.tally(a, b)[~near] < 5).any()


def test_clashing_names(spark):
    rows = [(k, prose(60, k // 2), "a", 1, 2, 3, 4) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, fp int, low int, row int, several int")
    kept = H.keep_one_per_group(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows[::2]
    assert {r.component_id for r in H.near_duplicates(df).collect()} == {0, 2, 4, 6, 8}


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([(f"k{k}", prose(60, k // 2)) for k in range(6)], "doc_id string, text string")
    assert sorted(r.component_id for r in H.near_duplicates(df).collect()) == ["k0", "k0", "k2", "k2", "k4", "k4"]
    assert sorted(r.doc_id for r in H.keep_one_per_group(df).collect()) == ["k0", "k2", "k4"]

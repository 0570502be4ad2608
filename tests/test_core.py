import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapdelta.config import DiffConfig
from snapdelta.functions import families, hashing, scores
from snapdelta.operators import filters, matching, near_dup, scoring
from snapdelta.plans.diff import Diff
from snapdelta.schema import CLASS, ROOT
from snapdelta.sources import sinks, tables
from snapdelta.sources.corpus import load


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ints(*values):
    return F.array(*map(F.lit, values)).cast("array<int>")


def strings(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def method(idx, descriptor="d", access="a", opcodes=None, declared=True, analysed=True, external=False, frm=(), to=()):
    return (idx, declared, analysed, external, descriptor, access, opcodes, list(frm), list(to))


def field(idx, descriptor="d", access="a", reads=0, writes=0, init=None, declared=True, analysed=True):
    return (idx, declared, analysed, descriptor, access, reads, writes, init)


def cls(snapshot, name, methods=(), fields=(), internal=True, flags="p", extends=ROOT, implements=(), frm=(), to=()):
    return (snapshot, name, internal, flags, extends, list(implements), list(methods), list(fields), list(frm), list(to))


CALL, ARITHMETIC = 0x6E, 0x90
X, Y = method(0, "x", "p", [ARITHMETIC - 0x3E, 0x20]), method(1, "y", "p")


@pytest.mark.parametrize(("text", "want"), [("", "811c9dc5"), ("a", "e40c292c"), ("foobar", "bf9cf968"), ("é", "1e9de8c1")])
def test_fnv(spark, text, want):
    assert f"{one(spark, hashing.fnv1a32(F.lit(text))):08x}" == want == f"{hashing.fnv1a32_py(text):08x}"


@pytest.mark.parametrize(("bag", "want"), [((), "00000000"), (("a",), "e40c292c"), (("a", "a", "b"), "e40c292c"), (("a", "b"), "e40c2924"), (("has_fields",) * 3 + ("no_fields",), "b2582741"), (("CALL", "MOVE", "ENDOFBASICBLOCK"), "d14254e4")])
def test_simhash(spark, bag, want):
    assert f"{one(spark, hashing.simhash32(strings(*bag))):08x}" == want


def test_native_simhash_equals_the_arrow_one(spark):
    live = load(spark, "/root/testdata/sf0.001").where(~filters.is_empty())
    native = {(r.snapshot, r.class_name, r.component): r.simhash for r in near_dup.native_components(live).collect()}
    for r in near_dup.with_signature(live).collect():
        for c in near_dup.COMPONENTS:
            assert native[r.snapshot, r.class_name, c] == r[c]


def test_families(spark):
    name = lambda o: one(spark, families.family_name(F.lit(o)))
    assert [name(o) for o in (0x6E, 0x73, 0x0300, 0x00, 0xFF, 0x0101, 0x43)] == ["CALL", None, "ARRAYACCESS", "NONE", "MOVE", None, None]
    assert sum(v is not None for v in families._LOW) + len(families._HIGH) == 227


def test_scores(spark):
    jaccard = lambda a, b: one(spark, scores.jaccard(strings(*a), strings(*b)))
    assert [jaccard([], []), jaccard("aab", "a"), jaccard([], "a")] == [1.0, 0.5, 0.0]
    count = lambda a, b: one(spark, scores.count_penalty(0.08, F.lit(a), F.lit(b)))
    mean = lambda a, b: one(spark, scores.mean_penalty(0.04, F.lit(a), F.lit(b)))
    assert [count(2, 2), count(2, 3), count(2, 5)] == pytest.approx([0.08, 0.072, 0.024])
    assert [mean(1.0, 1.5), mean(1.0, 3.0)] == pytest.approx([0.04, 0.018])
    assert one(spark, scores.avg_or_zero(ints())) == 0 and one(spark, scores.avg_or_zero(ints(1, 2))) == 1.5
    assert [one(spark, scores.method_code_sig(ints(*v))) for v in ([0, 1, 5, 11], [0, 0], [])] == [79, 32, 0]
    assert [one(spark, scores.code_score(F.lit(d))) for d in (0, 1, 4)] == pytest.approx([0.15, 0.12, 0.06])
    assert one(spark, scores.snap(F.lit(1 - 1e-9))) == 1.0


@pytest.mark.parametrize(("methods", "bits"), [
    ([method(0, opcodes=[0x00, 0x1F, 0x7B, 0x01])], "101011011"), ([method(0, opcodes=[0, 0])], "0"), ([], "0"), ([method(0, opcodes=None)], "0"), ([method(0, opcodes=[0x73])], "0"),
    ([method(0, opcodes=[0x6E, 0x7B]), method(1, opcodes=[0x7B, 0x6E])], "1010100"),  # equal signatures: the last wins
    ([method(0, opcodes=[0x6E, 0x6E]), method(1, opcodes=[0x7B])], "10101000100"), ([method(0, opcodes=[0x6E], declared=False)], "0"),
])
def test_code_sequence(spark, methods, bits):
    df = spark.createDataFrame([cls("a", "c", methods)], CLASS)
    assert df.select(scores.code_sequence(F.col("methods"))).first()[0] == bits


def score(spark, x, y):
    df = spark.createDataFrame([x, y], CLASS)
    a, b = (scoring.score_features(df.where(F.col("snapshot") == s)) for s in "ab")
    pairs = spark.createDataFrame([(x[1], y[1])], "class_a string, class_b string")
    return scoring.score_pairs(pairs, a, b).first()


def test_worked_example(spark):
    x = cls("a", "x", [method(0, "x", "p", [CALL, 0x0E]), method(1, "y", "p")])
    y = cls("b", "y", [method(0, "x", "p", [CALL, CALL, 0x0E]), method(1, "x", "p"), method(2, "x", "p")])
    got = score(spark, x, y)
    assert (got.fields_score, got.class_score, got.method_score, got.code_score) == pytest.approx((0.16, 0.372, 0.27, 0.06))
    assert got.score == pytest.approx(0.862)


def test_itself_and_one_sided_parts(spark):
    full = ([method(0, "x", "p", [CALL], frm=[(True, "q")], to=[(False, "r"), (True, "s")])], [field(0, reads=3)], True, "pub", "Lx;", ["i"], [("p", "k")], [("p", "k"), ("p", "l")])
    assert score(spark, cls("a", "x", *full), cls("b", "y", *full)).score == 1.0
    bare = cls("b", "y", [method(0, "x", "p", [CALL])])
    got = score(spark, cls("a", "x", *full), bare)
    assert got.fields_score == 0 and got.class_score == pytest.approx(0.08 + 0.06 * 0.9 + 0.05 * 0.9 + 0.05 * 0.9 + 0.04 * 0.9)
    unanalysed = score(spark, cls("a", "x", fields=[field(0, analysed=False)], methods=[X]), cls("b", "y", methods=[X]))
    assert unanalysed.fields_score == 0.16


def test_exclusion(spark):
    df = spark.createDataFrame([cls("a", n) for n in ("axb", "xb", "Lfr/X;", "fr/X")], CLASS)
    names = lambda d: sorted(r.class_name for r in d.collect())
    assert names(df.where(~filters.is_excluded(("ax", "xb")))) == ["Lfr/X;", "fr/X", "xb"]
    table = spark.createDataFrame([("ax",), ("xb",), (" ",), ("",), ("longer than any name",)], "value string")
    assert names(filters.without_excluded(df, table)) == ["Lfr/X;", "fr/X", "xb"]
    assert names(filters.without_excluded(df, table.limit(0))) == names(df) and names(filters.without_excluded(df.limit(0), table)) == []
    rng = random.Random(6)
    words = ["".join(rng.choices("ab/é", k=rng.randint(1, 9))) for _ in range(300)]
    parts = tuple({"".join(rng.choices("ab/é", k=rng.randint(1, 5))) for _ in range(25)})
    many = spark.createDataFrame([cls("a", n) for n in words], CLASS)
    got = names(filters.without_excluded(many, spark.createDataFrame([(p,) for p in parts], "value string")))
    assert got == names(many.where(~filters.is_excluded(parts))) == sorted(n for n in words if not any(p in n[1:] for p in parts))
    assert DiffConfig(("", " \n", "com/a\n")).excluded == ("com/a",) and tables.exclusion_entries("a; ;b;") == ("a", "b")
    with pytest.raises(ValueError):
        DiffConfig(hamming_distance=32)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != q))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="01", max_size=90), st.text(alphabet="01", max_size=90))
def test_bit_distance_equals_a_plain_table(a, b):
    assert scores.bit_distance(a, b) == plain_distance(a, b) == scores.bit_distance(b, a)


def test_edit_distance_column(spark):
    rng = random.Random(4)
    rows = [(a := "".join(rng.choices("01", k=rng.randint(1, 900))), a[: len(a) // 2] + "1" + a[len(a) // 2 + rng.randint(0, 40) :]) for _ in range(30)] + [("0", "0"), ("1", "0")]
    df = spark.createDataFrame(rows, "a string, b string").select(scores.edit_distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_numbered_simhash_and_other_hashes(spark):
    import zlib

    rng, names = random.Random(2), families.NAMES
    for _ in range(20):
        bag = rng.choices(range(13), k=rng.randint(0, 50))
        for fn in (hashing.fnv1a32_py, lambda t: zlib.crc32(t.encode())):
            got = one(spark, hashing.simhash32_numbered(ints(*bag), names, fn))
            assert got == hashing.simhash32_py([names[k] for k in bag], {}, fn)
    live = load(spark, "/root/testdata/sf0.001").where(~filters.is_empty())
    crc = {(r.snapshot, r.class_name, r.component): r.simhash for r in near_dup.native_components(live, F.crc32).collect()}
    for r in near_dup.with_signature(live, lambda t: zlib.crc32(t.encode())).collect():
        assert all(crc[r.snapshot, r.class_name, c] == r[c] for c in near_dup.COMPONENTS)


def test_spread_join(spark):
    from snapdelta.operators.skew import spread_join

    many = spark.range(2000).selectExpr("if(id < 1500, 1, id % 7) AS k", "id % 2 AS j", "id AS v")
    other = spark.range(21).selectExpr("id % 7 AS k", "id % 2 AS j", "id AS w")
    key = lambda df: sorted(map(tuple, df.select("k", "j", "v", "w").collect()))
    assert key(spread_join(many, other, ["k", "j"], 100)) == key(spread_join(many, other, ["k", "j"])) == key(many.join(other, ["k", "j"]))


@pytest.mark.parametrize("hot", [5, near_dup.HOT])
@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6, 8])
def test_block_join_equals_brute_force(spark, k, hot):
    rng = random.Random(k)
    base = [[rng.getrandbits(32) for _ in range(4)] for _ in range(6)]

    def rows(side):
        out = []
        for n in range(60):
            sig = list(rng.choice(base))
            for _ in range(rng.randint(0, k + 2)):
                sig[rng.randrange(4)] ^= 1 << rng.randrange(32)
            out.append((f"{side}{n}", *sig))
        return out

    a, b = rows("a"), rows("b")
    schema = "class_name string, " + ", ".join(f"{c} bigint" for c in near_dup.COMPONENTS)
    found = near_dup.near_dup_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), k, hot)
    got = sorted((r.class_a, r.class_b, r.hamming) for r in found.collect())
    distance = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x[1:], y[1:]))
    assert got == sorted((x[0], y[0], distance(x, y)) for x in a for y in b if distance(x, y) <= k)


def test_block_bounds_and_plan(spark):
    assert near_dup.block_bounds(3) == [(0, 32), (32, 32), (64, 32), (96, 32)]
    assert near_dup.block_bounds(4) == [(0, 25), (25, 25), (50, 25), (75, 25), (100, 28)]
    diff = Diff(load(spark, "/root/testdata/sf0.001"))
    plan = diff.pairs._jdf.queryExecution().toString()
    diff.release()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pruned_best_equals_unpruned(spark):
    diff = Diff(load(spark, "/root/testdata/sf0.01"))
    key = lambda df: sorted((r.class_a, round(r.score, 9), tuple(r.candidates)) for r in df.collect())
    assert key(diff.best) == key(matching.best_match(diff.scored))
    similar, deleted = diff.best.count(), diff.deleted.count()
    assert similar + deleted == diff.side("a").count() and diff.pairs.select("class_b").distinct().count() + diff.added.count() == diff.side("b").count()
    assert diff.scored.where("score <= 0 or score > 1").count() == 0
    diff.release()


def test_small_snapshots(spark, tmp_path):
    m = [method(0, "x", "p", [CALL, 0x0E])]
    rows = [cls("a", "La;", m), cls("a", "Lgone;", [method(0, "zzz", "q", [0x12] * 9)], [field(0, "f", "g", 4, 4)], to=[("u", "v")]), cls("a", "Lempty;"), cls("a", "Lout;", m, internal=False), cls("a", "Lcom/x;", m),
            cls("b", "La;", m), cls("b", "Lb;", m), cls("b", "Lnew;", [method(0, "qq", "r", [0x90] * 3)], implements=["i", "j"], extends="Lz;")]
    diff = Diff(spark.createDataFrame(rows, CLASS), DiffConfig(("com/",)))
    got = sorted((r.class_name, r.status, r.candidates) for r in diff.status().collect())
    assert got == [("La;", "similar", "La;,Lb;"), ("Lempty;", "empty", ""), ("Lgone;", "deleted", ""), ("Lnew;", "added", "")]
    assert sorted(r.line for r in diff.report().collect()) == ["La; -> [La; Lb;]", "Lgone; -> none"]
    s = diff.summary().first()
    assert (s.unmapped_a, s.unmapped_b) == (0, 0)
    assert (s.classes_a, s.classes_b, s.pairs, s.with_candidates, s.without_candidates, s.mean_candidates, s.name_absent) == (2, 3, 2, 1, 1, 2.0, 0)
    sinks.write_results(diff, str(tmp_path / "run"))
    assert {p.name for p in (tmp_path / "run").iterdir()} == {"simhash_results", "similar_classes", "deleted_classes", "added_classes", "empty_classes", "summary", "status"}
    assert spark.read.text(str(tmp_path / "run/similar_classes")).first().value == "La; -> La; Lb; | 1.0"
    assert sinks.write_html(diff, str(tmp_path / "html")) == {"similar": 1, "added": 1, "deleted": 1, "empty": 1}
    diff.release()
    strict = Diff(spark.createDataFrame(rows, CLASS), DiffConfig(empties_need_exclusions=True, obfuscated=True, threshold=1.1))
    assert strict.empty.count() == 0 and strict.best.count() == 0 and "name_absent" not in strict.summary().columns
    strict.release()


def test_nothing_to_compare(spark):
    diff = Diff(spark.createDataFrame([], CLASS))
    assert diff.status().count() == 0 and diff.summary().first().mean_candidates is None
    diff.release()


def test_html_is_escaped(spark, tmp_path):
    diff = Diff(spark.createDataFrame([cls("a", "L<b>;", [X])], CLASS))
    sinks.write_html(diff, str(tmp_path / "h"))
    diff.release()
    assert "L&lt;b&gt;;" in (tmp_path / "h/deleted.html").read_text()


def test_ranking(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5 + 1e-12), ("a", "z", 0.4), ("b", "x", 0.2)], "class_a string, class_b string, score double")
    assert {r.class_a: r.candidates for r in matching.best_match(df).collect()} == {"a": ["x", "y"], "b": ["x"]}
    assert [(r.class_a, r.class_b) for r in matching.best_above(df, 0.3).collect()] == [("a", "x")]


def test_folding_flat_tables(spark):
    key = {"snapshot": "a", "class_name": "c"}
    df = lambda rows, schema: spark.createDataFrame([tuple({**key, **r}.values()) for r in rows], "snapshot string, class_name string, " + schema)
    classes = spark.createDataFrame([("a", "c", True, "p", ROOT, []), ("a", "none", True, "p", ROOT, [])], "snapshot string, class_name string, is_internal boolean, access_flags string, extends string, implements array<string>")
    m = df([dict(idx=i, declared=True, analysed=True, is_external=False, descriptor=f"m{i}", access="p", opcodes=[i]) for i in (1, 0)], "idx int, declared boolean, analysed boolean, is_external boolean, descriptor string, access string, opcodes array<int>")
    f = df([dict(idx=0, declared=True, analysed=True, descriptor="f", access="p", n_read=1, n_write=2, init_value=None)], "idx int, declared boolean, analysed boolean, descriptor string, access string, n_read bigint, n_write bigint, init_value string")
    cx = df([dict(direction="to", peer="p", kind="k")], "direction string, peer string, kind string")
    mx = df([dict(idx=1, direction="from", peer_is_class=True, peer_access="q")], "idx int, direction string, peer_is_class boolean, peer_access string")
    out = {r.class_name: r for r in tables.fold(classes, m, f, cx, mx).collect()}
    c = out["c"]
    assert [x.descriptor for x in c.methods] == ["m0", "m1"] and c.methods[1].xref_from[0].peer_access == "q" and not c.methods[0].xref_from
    assert c.fields[0].n_write == 2 and c.xref_to[0].kind == "k" and c.xref_from == [] and out["none"].methods == []


def test_command_line(spark, tmp_path):
    from snapdelta.cli import main

    rows = load(spark, "/root/testdata/sf0.001").drop("doc_id", "source")
    for s in "ab":
        rows.where(F.col("snapshot") == s).write.parquet(str(tmp_path / s))
    (tmp_path / "ex.txt").write_text("fr/\n\n")
    folder = main([str(tmp_path / "a"), str(tmp_path / "b"), "--excpkgs", "D1;", "-f", str(tmp_path / "ex.txt"), "--output", str(tmp_path / "out"), "--html"])
    status = spark.read.parquet(f"{folder}/status")
    assert status.count() > 0 and status.where("class_name like 'Lfr/%' or class_name like '%D1%'").count() == 0
    phases = {r.phase: r for r in spark.read.json(f"{folder}/phases").collect()}
    assert set(phases) == {"signatures", "near_duplicates", "scores", "results"} and phases["results"].rows == status.count() and all(p.seconds > 0 for p in phases.values())


def test_unmapped_opcodes_are_counted(spark):
    rows = [cls("a", "La;", [method(0, opcodes=[0x73, 0x0E, 0x73]), method(1, opcodes=[0xE5], declared=False), method(2)]), cls("b", "La;", [method(0, opcodes=[0x0E, 0x101])])]
    diff = Diff(spark.createDataFrame(rows, CLASS))
    s = diff.summary().first()
    diff.release()
    assert (s.unmapped_a, s.unmapped_b) == (2, 1)


def test_code_is_whole(spark):
    """Opcodes of every line, over its whole length."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = F.aggregate("methods", F.lit(0).cast("bigint"), lambda n, m: n + F.size(m["opcodes"]))
    got = {r.doc_id: r.n for r in load(spark, "/root/testdata/sf0.001").select("doc_id", coded.alias("n")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == sum(len(x) for x in (r.text or "").split("\n") if len([w for w in x.split(" ") if w]) >= 2)


def test_queries_let_go_of_what_they_keep(spark):
    import gc

    from snapdelta.plans.queries import QUERIES

    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    gc.collect()
    before = kept()
    result = QUERIES["near_dup_join"](spark, "/root/testdata/sf0.001")
    assert result.count() > 0 and kept() > before
    del result
    gc.collect()
    assert kept() <= before


def test_results_are_whole_without_what_was_kept(spark):
    """Of a result that is gone when a frame made from it runs, and after the cache was cleared."""
    import gc

    from snapdelta.plans.queries import QUERIES

    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.collect()))
    gc.collect()
    before = kept()
    derived = QUERIES["jaccard"](spark, d).select("class_a", "class_b", "jaccard")
    gc.collect()
    got = rows(derived)
    assert got and kept() > before
    spark.catalog.clearCache()
    assert rows(derived.select("*")) == got
    del derived
    gc.collect()
    left = kept()
    deleted = QUERIES["deleted_anti"](spark, d)
    assert deleted.count() >= 0 and kept() > left
    del deleted
    gc.collect()
    assert kept() == left


def test_method_score_sums_as_its_sql_does(spark):
    """In another order of sums these parts end a millionth lower."""
    names = ("m_descriptors", "m_access", "m_from_access", "m_to_access")
    side = lambda *sets: F.struct(*(strings(*v).alias(n) for n, v in zip(names, sets, strict=True)), F.lit(0.0).alias("m_from"), F.lit(2.0).alias("m_to"))
    every = tuple(map(str, range(32)))
    a, b = side(("x",), every, (), ("u",)), side(("y",), ("0",), (), ("u",))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).select(scores.micro(scoring.method_score()).alias("x")).first()
    assert row.x == 162188


@settings(max_examples=200, deadline=None)
@given(st.text("01", min_size=1, max_size=90), st.text("01", min_size=1, max_size=90))
def test_least_distance(a, b):
    for x, y in ((a, b), (a, a[: len(a) // 2] + b + a[len(a) // 2 :])):
        assert scores.least_distance(scores.stretches(x), scores.stretches(y), abs(len(x) - len(y))) <= scores.bit_distance(x, y)


def test_best_above_aligns_contenders_only(spark):
    rng = random.Random(5)
    bits = lambda n: "".join(rng.choices("01", k=n))
    diff = Diff(load(spark, "/root/testdata/sf0.001"))
    first = diff.features("a").limit(1).drop("class_name", "code")
    codes = lambda names, n: first.crossJoin(spark.createDataFrame([(x, bits(n + 400 * i)) for i, x in enumerate(names)], "class_name string, code string"))
    a, b = codes(["p", "q"], 3000), codes([f"c{i}" for i in range(6)], 3000)
    pairs = spark.createDataFrame([(x, f"c{i}") for x in "pq" for i in range(6)], "class_a string, class_b string")
    every, some = scoring.score_pairs(pairs, a, b), scoring.score_contenders(pairs, a, b)
    want = sorted(matching.best_above(every, 0.5).collect())
    assert every.count() == 12 and 2 <= some.count() < 12 and len(want) == 2
    assert sorted(matching.best_above(some, 0.5).collect()) == want
    assert sorted(diff.best_above(0.5).collect()) == sorted(matching.best_above(diff.scored, 0.5).collect())
    assert diff.contenders.count() <= diff.scored.count()
    diff.release()


@pytest.mark.parametrize("columns", [3, scores.COLUMNS])
def test_band_distance(monkeypatch, columns):
    """Exact where the band is wide enough for the distance found, never too low, and of strings longer than one cut."""
    monkeypatch.setattr(scores, "COLUMNS", columns)
    rng = random.Random(11)
    bits = lambda n: "".join(rng.choices("01", k=n))
    narrow = 0
    for _ in range(150):
        a = bits(rng.randint(20, 120))
        b = rng.choice([bits(rng.randint(1, len(a))), a[rng.randint(1, 9) :] + bits(1), a[len(a) // 2 :] + a[: len(a) // 2]])
        want, gap = plain_distance(a, b), len(a) - len(b)
        for edge in (0, 1, 4, 12, len(b)):
            got = scores._band_distance(a, b, edge)
            assert got >= want and (got == want or got - gap > 2 * edge + 1)
            narrow += got > want
        assert scores.bit_distance(a, b) == scores.bit_distance(b, a) == want
    assert narrow
    a = bits(1500)
    for b in (a[40:700] + bits(9) + a[720:] + bits(5), bits(1400), bits(300) + a[:900], a[750:] + a[:750]):
        assert scores.bit_distance(a, b) == plain_distance(a, b)


def test_codes_that_meet_again_are_aligned_once(spark):
    """Three classes with one code against four with another, and the other way round: one distance of two codes."""
    diff = Diff(load(spark, "/root/testdata/sf0.001"))
    first = diff.features("a").limit(1).drop("class_name", "code")
    side = lambda rows: first.crossJoin(spark.createDataFrame(rows, "class_name string, code string"))
    x, y = "1" + "0110" * 50, "1" + "0111" * 60
    a = side([("a0", x), ("a1", x), ("a2", x), ("a3", y)])
    b = side([("b0", y), ("b1", y), ("b2", y), ("b3", y), ("b4", x)])
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(4) for j in range(5)], "class_a string, class_b string")
    want = plain_distance(x, y)
    assert [r.distance for r in scoring._code_distances(pairs, a, b).collect()] == [want]
    got = {(r.class_a, r.class_b): r.code_score for r in scoring.score_pairs(pairs, a, b).collect()}
    assert len(got) == 20
    for (p, q), score in got.items():
        assert score == (0.15 if (p == "a3") != (q == "b4") else 0.12 / want**0.5)
    diff.release()


def test_sub_scores_need_no_alignment(spark):
    from snapdelta.plans.queries import QUERIES

    for name in ("fields_score", "class_score", "method_score"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "high_id" not in plan


DROPPED = "ratio_penalty code_score method_score score_pairs similarity_score best_match best_above_threshold".split()


@pytest.mark.parametrize("name", DROPPED)
def test_frame_of_a_dropped_result_equals_its_sql(spark, name):
    """What the comparison keeps mustn't go with the result object while a frame made from it runs."""
    import gc

    import __spark_entry__ as entry
    from tests.oracle import spark_rows, sql_rows

    d = "/root/testdata/sf0.001"
    derived = entry.queries()[name](spark, d).select("*")
    gc.collect()
    assert spark_rows(derived) == sql_rows(entry.oracle_sql()[name], d)


@pytest.mark.parametrize("lanes", [True, False])
def test_jvm_distance(spark, lanes):
    """Both inner loops, along bands narrow and wide; never too low where the band is too narrow."""
    from snapdelta.functions import bits

    made = bits.compiled(spark, lanes).getClassLoader().loadClass("snapdelta.BitDistance").newInstance()
    rng = random.Random(17)
    draw = lambda n: "".join(rng.choices("01", k=n))
    edited = lambda a, x: "".join(c if rng.random() > x else rng.choice(["", "0", "1", "01"]) for c in a)
    for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 300, 700):
        a = draw(n)
        for b in (a, "", draw(1), draw(n), draw(n // 2), edited(a, 0.1), edited(a, 0.5), a[n // 2 :] + a[: n // 2], a[n // 3 :] + draw(40)):
            assert made.distance(a.encode(), b.encode()) == made.distance(b.encode(), a.encode()) == plain_distance(a, b)
    for n in (2000, 6000, 9000):
        a = draw(n)
        for b in (draw(n - 300), edited(a, 0.05), edited(a, 0.3), a[1000:] + draw(900), draw(70)):
            assert made.distance(a.encode(), b.encode()) == scores.bit_distance(a, b)
    words = lambda a: spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, len(a) // 64 + 17)
    narrow = 0
    for _ in range(25):
        a = draw(rng.randint(300, 900))
        b = edited(draw(9) + a, 0.2)[: len(a)]
        ones, columns = words(a), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, len(b) + 16)
        for k in range(0, len(a), 64):
            value = int(a[k : k + 64][::-1], 2)
            ones[k // 64] = value - (1 << 64) if value >> 63 else value
        for j, c in enumerate(b, 1):
            columns[len(b) - j] = 0 if c == "1" else -1
        want, gap = plain_distance(a, b), len(a) - len(b)
        for edge in (1, 8, 40, len(b)):
            got = made.along(ones, columns, len(a), len(b), edge)
            assert got >= want and (got == want or got - gap > 2 * edge + 1)
            narrow += got > want
    assert narrow


def test_alignments_run_in_the_jvm(spark):
    """Python's whole numbers took twenty times as long for all pairs' distances."""
    rows = [("0" * 40 + "1", "1"), (None, "1"), ("10", None), ("0110", "0110")]
    df = spark.createDataFrame(rows, "a string, b string").select(scores.edit_distance(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [40, None, None, 0]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_packed_codes(spark):
    """Each pair of ``score_pairs`` carried the characters of a code, 17 KB of 46,700 bits after the shuffle's compression."""
    from snapdelta.functions import bits

    rng = random.Random(23)
    texts = ["", "0", "1", "01", "0001", "10001", "0" * 257, *("".join(rng.choices("01", k=rng.randint(1, 3000))) for _ in range(40)), "111" + "011101000011" * 4000]
    df = spark.createDataFrame([(x, texts[i - 1]) for i, x in enumerate(texts)], "a string, b string")
    small = df.select("a", "b", bits.packed(spark, F.col("a")).alias("x"), bits.packed(spark, F.col("b")).alias("y"))
    got = small.select("a", "b", F.length("x").alias("n"), bits.packed_distances(spark, F.col("x"), F.col("y")).alias("d"), bits.bit_distances(spark, F.col("a"), F.col("b")).alias("e")).collect()
    assert len(got) == len(texts) and all(r.d == r.e == scores.bit_distance(r.a, r.b) and r.n <= len(r.a) / 6 + 90 for r in got)
    diff = Diff(load(spark, "/root/testdata/sf0.001"))
    plan = diff.scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Pack(" in plan and "PackedDistance(" in plan
    diff.release()


def documents_dir(spark, folder, rows):
    """Tables with these documents (doc_id, text, lang) and no label of theirs."""
    from pathlib import Path

    from tests.oracle import TABLES

    for t in set(TABLES) - {"documents"}:
        Path(folder, f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    kinds = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame([(*r, "web") for r in rows], kinds).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


TEXTS = [" ".join(f"{w}{i % 3}" for i in range(k)) + "\nsecond line of longestwordever" for w, k in (("alphabet", 9), ("signature", 14), ("x", 30))]


@pytest.mark.parametrize("name", ["score_pairs", "ratio_penalty", "code_score", "similarity_score", "best_match"])
def test_large_ids_equal_sql(spark, tmp_path, name):
    """Half of an id beyond 2^53 was taken as a double, so classes got each other's names and rows."""
    import __spark_entry__ as entry
    from tests.oracle import spark_rows, sql_rows

    d = documents_dir(spark, tmp_path, [((1 << 60) + i, TEXTS[i // 4], "en") for i in range(12)])
    got, want = spark_rows(entry.queries()[name](spark, d)), sql_rows(entry.oracle_sql()[name], d)
    assert want[1] and got == want


@pytest.mark.parametrize("name", ["ratio_penalty", "code_score", "score_pairs", "similarity_score", "best_match"])
def test_classes_without_a_name_equal_sql(spark, tmp_path, name):
    """Classes without a language have no name: their rows were lost, and their class component was 0."""
    import __spark_entry__ as entry
    from tests.oracle import spark_rows, sql_rows

    langs = [None, None, "en", "en", "e\nn", "", None, None]
    d = documents_dir(spark, tmp_path, [(i, TEXTS[(i // 8) % 2], langs[i % 8]) for i in range(24)])
    got, want = spark_rows(entry.queries()[name](spark, d)), sql_rows(entry.oracle_sql()[name], d)
    assert any(None in r for r in want[1]) and got == want


def test_tiles_equal_columns(spark, monkeypatch):
    """Features went along with each pair, 2.7 KB of them, so the shuffle grew as the pairs; a class's go to each tile once now."""
    monkeypatch.setattr(scoring, "PARTS_AT_LEAST", 3)
    diff = Diff(load(spark, "/root/testdata/sf0.001"))
    a, b = (diff.plain_features(s).persist() for s in "ab")
    # also classes without sets, with null members and with numbers that are missing
    odd = lambda df: df.withColumns({"f_access": F.when(F.col("n_methods") % 5 > 0, F.col("f_access")), "m_access": F.concat("m_access", F.array(F.lit(None).cast("string"))), "reads": F.when(F.col("n_methods") % 7 > 0, F.col("reads"))})
    for x, y in ((a, b), (odd(a), odd(b))):
        names = x.select(F.col("class_name").alias("class_a")).orderBy("class_a").limit(40).crossJoin(y.select(F.col("class_name").alias("class_b")).orderBy("class_b").limit(30))
        want = scoring.attach(names, x, y).select("class_a", "class_b", *(f().alias(n) for n, f in scoring.PARTS.items()), (F.col("a.code") == F.col("b.code")).alias("same"), F.length("a.code").alias("n_x"), F.length("b.code").alias("n_y"))
        assert sorted(map(str, scoring.sub_scores(names, x, y).collect())) == sorted(map(str, want.collect()))
    plan = diff.contenders._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BestDistances(" in plan and "MapInPandas" not in plan
    a.unpersist(), b.unpersist(), diff.release()


def test_best_distances(spark):
    """Exact wherever the total can reach the best; left out only where it can't."""
    from snapdelta.functions import bits

    rng = random.Random(29)
    draw = lambda n: "".join(rng.choices("01", k=n))
    own = draw(2500)
    others = [own[:900] + draw(5) + own[910:], own[40:] + draw(30), draw(2500), draw(2300), own[:60] + draw(2000), None, own[:1200]]
    rows = [(own, x, floor, [o for o in others if o or x == "all"]) for floor in (0.0, 0.3, 0.31) for x in ("all", "different")]
    pack = lambda c: bits.packed(spark, c)
    df = spark.createDataFrame(rows, "own string, kind string, floor double, others array<string>")
    ys = df.select("own", "kind", "floor", "others", F.posexplode("others").alias("i", "y")).withColumn("y", pack(F.col("y"))).groupBy("own", "kind", "floor", "others").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("y"))
    bases = lambda: F.transform("others", lambda o: F.when(F.length(o) == 2500, 0.299).otherwise(0.3))
    got = ys.select("own", "others", "floor", bits.best_distances(spark, pack(F.col("own")), F.col("y.y"), bases(), F.transform("others", lambda o: F.lit(1.0)), F.col("floor")).alias("d")).collect()
    assert len(got) == len(rows)
    for r in got:
        best, left_out = r.floor, 0
        for o, d in zip(r.others, r.d, strict=True):
            want, base = (0, 0.3) if o is None else (scores.bit_distance(own, o), 0.299 if len(o) == 2500 else 0.3)
            total = base + (0.12 / want**0.5 if want else 0.15)
            assert d == want or d == -1 and total < best - scoring.NEAR
            left_out += d == -1
            best = max(best, total if d >= 0 else 0)
        assert left_out

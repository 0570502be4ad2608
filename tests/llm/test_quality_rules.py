import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from snapdelta.llm import quality_rules as Q
from tests.llm.conftest import prose


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Q.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Q.judge(docs.limit(0)).count() == 0
    assert Q.keep_good(docs).columns == docs.columns


def test_common_words_are_those_of_all_lengths(spark, docs):
    rows = [(i, f"boilerplate {prose(40, i)} boilerplate", "en") for i in range(5)] + [(9, " ".join(f"longword{k % 5}" for k in range(80)), "zh"), (10, " ".join(f"longword{k}" for k in range(80)), "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for texts in (df, docs):
        sums = {}
        for r in texts.collect():
            sums.setdefault(r.lang, Counter()).update(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        got = {r.language: r for r in Q.references(texts).collect()}
        assert set(got) == set(sums)
        for language, n in sums.items():
            want = sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:16]
            assert got[language].common == [w for w, _ in want]
            assert got[language].common_shares == [h / sum(n.values()) for _, h in want]
    distances = {r.doc_id: r.word_distance for r in Q.judge(df).collect()}
    assert distances[9] > 0 and distances[10] > 0


def test_repeats(spark):
    a, b = "a b c d e f", "u v w x y z"
    texts = [f"{a} {b} {a} {b}", " ".join(["x"] * 9), f"{a} q {a} r", "a b c d e a b c d e", f"{a}  {b}", "a b c d e", "1 2 3 4 5 6 7 8 9 1 2 3 4 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "text", "'en' lang")
    assert [(r.n_words, r.n_repeat_words) for r in Q.judge(df).orderBy("doc_id").collect()] == [(plain(t)[0], plain(t)[4]) for t in texts]


def test_distance(spark):
    def brute(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return math.sqrt(sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2)

    cases = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0, 2.0, 3.0], [3.0, 1.0, 0.0])]
    df = spark.createDataFrame(cases, "p array<double>, q array<double>")
    for r, (p, q) in zip(df.select(Q.distance(df.p, df.q).alias("d")).collect(), cases):
        assert abs(r.d - brute(p, q)) < 1e-7
    none = spark.createDataFrame([([0.0], [1.0])], "p array<double>, q array<double>")
    assert none.select(Q.distance(none.p, none.q)).first()[0] is None


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = Q.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    long = [r for r in got if not r.base_failed]
    good = [r.kept for r in long if r.quality == 1]
    bad = [r.kept for r in long if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_main_path_is_native(spark, docs):
    plan = Q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def rows_by_sql(df):
    con = duckdb.connect()
    view = pa.table({"doc_id": pa.array([r.doc_id for r in df.collect()], pa.int64()), "text": pa.array([r.text for r in df.collect()], pa.string()), "lang": pa.array([r.lang for r in df.collect()], pa.string())})
    con.register("documents", view)
    out = con.sql(Q.oracle())
    return sorted((tuple(r[out.columns.index(c)] for c in COLUMNS) for r in out.fetchall()), key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


@pytest.mark.parametrize("most_languages", [1, 10_000])
def test_sql_gives_the_same(spark, docs, most_languages):
    """Counts, references, distances and verdicts; with references that are broadcast and that aren't."""
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs.select("doc_id", "text", "lang"), files):
        got = sorted((tuple(r) for r in Q.judge(df, most_languages=most_languages).select(*COLUMNS).collect()), key=str)
        assert got == rows_by_sql(df)
        assert len({r[7] for r in got}) == 2 and sum(r[8] is not None for r in got) > 10 and sum(r[9] is not None for r in got) > 10


def test_null_and_empty_languages_and_clashing_names(spark):
    rows = [(k, prose(80, k) if k % 3 else "zu zu zu zi zo " * 30, [None, "", "en"][k % 3], "w", 1, 2) for k in range(18)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __words string, row int, m int")
    assert {r.language for r in Q.references(df).collect()} == {None, "", "en"}
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    want = {r.doc_id for r in Q.judge(df).collect() if r.kept}
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in want) and 0 < len(want) < len(rows)


def test_a_filter_measures_texts_once(spark, docs):
    trims = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("trim(")
    assert trims(Q.keep_good(docs)) == trims(Q.judge(docs))

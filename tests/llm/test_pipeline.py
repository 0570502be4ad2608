import numpy as np
import pytest

import corpus_pipeline as P
from snapdelta.llm import curve_packing, quality_rules, simhash_dedup, site_classifier
from tests.llm.test_simhash import brute_components, plain_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = P.table(spark, D, "documents"), []
    for _, stage in P.STAGES:
        out.append((docs, docs := P.written(stage(spark, docs, D), "test")))
    return out


def test_columns_and_effect(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()
    assert stages[0][1].count() < stages[0][0].count()


def test_stages_equal_brute_force(spark, stages):
    (docs, a), (_, b), (_, c), (_, packed) = stages
    verdicts = {r.doc_id: r.kept for r in site_classifier.judge(docs, P.table(spark, D, "labels")).collect()}
    assert {r.doc_id for r in a.collect()} == {i for i, k in verdicts.items() if k}
    rules = {r.doc_id: r.kept for r in quality_rules.judge(a).collect()}
    assert {r.doc_id for r in b.collect()} == {i for i, k in rules.items() if k}
    reach = brute_components({r.doc_id: plain_fingerprint(r.text) for r in b.collect()})
    low = {}
    for i, root in reach.items():
        low[root] = min(i, low.get(root, i))
    assert sorted(r.doc_id for r in c.collect()) == sorted(low.values())
    tool = curve_packing.tokens(curve_packing.__name__ and P.public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(np.frombuffer(tool(r.text or ""), "<u4")) + 1 for r in c.collect()}
    got = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert got == sizes


def test_run(spark, stages):
    key = ["doc_id", "start"]
    assert P.run(spark, D).groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect() == stages[-1][1].groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect()
    assert set(key) <= set(stages[-1][1].columns)


def test_awkward_documents_pass_all_stages(spark, docs):
    now = docs
    for _, stage in P.STAGES:
        now = P.written(stage(spark, now, D), "test")
    assert now.count() > 0
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = P.written(stage(spark, none, D), "test")
    assert none.count() == 0
    assert simhash_dedup.keep_one_per_group(docs).columns == docs.columns

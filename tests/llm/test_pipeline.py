from __future__ import annotations


import pytest
import corpus_pipeline as cp
from conftest import SMALL_SF

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import langid, toxicity as tox
from shelfwise.llm.common import read_table

from test_jaccard_join import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the smallest tables."""
    docs = read_table(spark, SMALL_SF, "documents")
    out = []
    for k, (name, stage) in enumerate(cp.STAGES):
        got = stage(spark, docs, SMALL_SF)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        got.write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages_keep_the_columns_and_their_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "language_id", "ngram_jaccard_join", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions_take_effect(spark, stages):
    (_, docs, clean), (_, _, known), (_, _, single), (_, _, packed) = stages
    model = tox.fit(docs, read_table(spark, SMALL_SF, "labels"))
    scores = {r.doc_id: r.predicted for r in tox.score(docs, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if p == 0}
    labels = {r.doc_id: r.toxic for r in read_table(spark, SMALL_SF, "labels").collect()}
    assert all(scores[i] == 0 for i, y in labels.items() if y == 0)  # clean documents stay
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(clean, langid.fit(clean)).collect()}
    assert {r.doc_id for r in known.collect()} == {i for i, (v, s) in found.items() if v != "und" and s >= cp.LEAST_LANGUAGE_SCORE}
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, c in brute(rows) if i == c)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_run_equals_the_stages(spark, stages):
    got = cp.run(spark, SMALL_SF)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r)[:5] for r in stages[-1][2].collect())


def test_odd_rows_pass_the_filters(spark, make_docs):
    docs = make_docs([(1, "the river of the town and the water is in the night"), (None, "the river of the town and a night"),
                      (2, None), (3, ""), (1, "the river of the town and the water is in the night")])
    clean = cp.toxicity(spark, docs, SMALL_SF)
    assert clean.count() == 5 and clean.columns == docs.columns
    assert cp.language_id(spark, docs.limit(0).withColumnRenamed("class", "lang"), SMALL_SF).count() == 0
    single = cp.ngram_jaccard_join(spark, docs, SMALL_SF)
    assert sorted((r.doc_id for r in single.collect()), key=str) == sorted([1, None, 2, 3], key=str)

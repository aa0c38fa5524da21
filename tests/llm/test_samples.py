"""Learning samples: bounded in distinct ids, whole texts of any length, the same whatever repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import common, langid, quality, toxicity


def test_a_repeated_id_counts_once(spark):
    rows = spark.range(300).unionAll(spark.range(7, 8).crossJoin(spark.range(2000)).select(F.lit(7).cast("long").alias("id")))
    got = [r.id for r in common.sample_by_hash(rows, "id", 50, 300).collect()]
    assert len(got) == len(set(got)) == 50
    place = {r.id: r.p for r in spark.range(300).select("id", common.hash_place("id").alias("p")).collect()}
    assert sorted(got) == sorted(sorted(place, key=lambda i: (place[i], i))[:50])


def test_one_text_per_id(spark, make_docs):
    docs = make_docs([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c"), (None, "d")])
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, y int")
    got = common.sampled_texts(docs, sample, "doc_id", "text").select("id", "y", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (3, 1, "c")]


def test_toxicity_learns_from_long_texts(spark, make_docs):
    """All toxic texts are long, and one id repeats more often than the bounds allow rows."""
    docs = [(k, "calm words about the garden and the sea " * 5) for k in range(60)]
    docs += [(k, "calm words about the garden " * 700 + "vilescum filthrot ") for k in range(60, 120)]
    labels = [(k, int(k >= 60)) for k in range(120)]
    frame = spark.createDataFrame(labels + [(0, 0)] * 4000, "doc_id long, toxic int")
    model = toxicity.fit(make_docs(docs + [(0, "other")] * 20), frame)
    got = {r.doc_id: r.predicted for r in toxicity.score(make_docs(docs), model).collect()}
    assert all(got[k] == int(k >= 60) for k in range(120))


def test_sample_ends_at_a_number_of_characters(spark, make_docs, monkeypatch):
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, **kw: seen.append(len(texts)) or plain(texts, y, epochs=1))
    docs = make_docs([(k, ("good day " if k % 2 else "vile day ") * 100) for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 9_000)
    assert toxicity.fit(docs, labels) is not None
    assert seen == [16]  # ten whole texts a label, of which a fifth is kept back for the thresholds


def test_languages_are_bounded(spark, make_docs, monkeypatch):
    rows = [(k, "the cat and the dog", "en") for k in range(30)] + [(100 + k, "der hund und die katze", "de") for k in range(20)]
    rows += [(200 + k, f"word{k}", f"dirty-{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    model = langid.fit(docs)
    assert sorted(v for own in model.members for v in own) == ["de", "en"]


def test_quality_learns_each_text_with_its_own_votes(spark, make_docs):
    good = "The garden is full of light, and the people who walk in it are happy to be there for the day. " * 4
    docs = [(k, good) for k in range(40)] + [(k, "$$$ ### buy!!! 111 222 " * 30) for k in range(40)]  # every id twice
    model = quality.fit(make_docs(docs))
    got = {r.doc_id: r.score for r in quality.score(make_docs([(1, good), (2, "$$$ ### buy!!! 111 222 " * 30)]), model).collect()}
    assert set(got) == {1, 2} and all(0 <= v <= 1 for v in got.values())

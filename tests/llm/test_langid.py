from __future__ import annotations

import random
import zlib

import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import langid

SYLLABLES = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ein", "ver", "ä"], "fr": ["eau", "que", "é", "ment", "oi"],
             "es": ["ción", "ñ", "ado", "que", "os"]}


def rows_of(rng, n):
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        out.append((k, " ".join(words), lang if k % 9 else None, lang))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows = rows_of(random.Random(4), 500)
    docs = spark.createDataFrame([(i, t, v, 1.5) for i, t, v, _ in rows], "doc_id long, text string, lang string, score double")
    return rows, docs, langid.fit(docs)


def test_held_out_accuracy_and_split(case):
    rows, docs, model = case
    assert sorted(model.families) == ["germanic", "romance"]
    truth = {i: v for i, _, _, v in rows}
    got = langid.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_cases(case, make_docs):
    rows = [(1, None), (2, ""), (3, "123 !? 。"), (4, "日本語"), (5, "thing " * 40_000), (None, "the"), (7, "é"), (7, "é")]
    got = {(r.doc_id): r for r in langid.identify(make_docs(rows), case[2]).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert all(got[k].lang_pred in SYLLABLES for k in (4, 5, None, 7))
    assert langid.identify(make_docs([]), case[2]).count() == 0


def test_nothing_or_one_language_to_learn(spark, make_docs):
    schema = "doc_id long, text string, lang string"
    assert langid.fit(spark.createDataFrame([(1, "a", None)], schema)) is None
    assert langid.identify(make_docs([(1, "word")]), None).first().lang_pred == "und"
    one = langid.fit(spark.createDataFrame([(k, "word", "xx") for k in range(20)], schema))
    assert langid.identify(make_docs([(1, "word"), (2, "1")]), one).collect()[0].lang_pred == "xx"


def test_unknown_codes_are_families_of_their_own():
    assert langid.family_of("de-AT") == "germanic" and langid.family_of("tlh") == "tlh"

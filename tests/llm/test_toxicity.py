from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import toxicity as tox
from shelfwise.llm.common import text_chunks

STEMS = ["grum", "snarl", "vexe"]


def texts(rng, n):
    rows = []
    for k in range(n):
        w = ["".join(rng.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 90))]
        bad = k % 3 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(STEMS) + rng.choice(["ta", "lo", "xi", "quor", "ble"])
        rows.append((k, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def case(spark):
    rows = texts(random.Random(2), 900)
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 4] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, tox.fit(docs, labels)


def test_held_out_accuracy(case):
    rows, docs, _, model = case
    truth = {i: y for i, _, y in rows}
    got = [r for r in tox.score(docs, model).collect() if r.held_out]
    assert len(got) > 200 and len(tox.score(docs, model).columns) == 4
    right = sum(r.predicted == truth[r.doc_id] for r in got) / len(got)
    assert right > 0.95
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)


def test_split_is_by_checksum(case):
    import zlib
    got = tox.score(case[1], case[3]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_defined_cases(case, make_docs):
    model = case[3]
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "ta lo " * 60_000), (None, "ta"), (5, "ta"), (5, "ta")]
    got = tox.score(make_docs(rows), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] and by[5] == by[None] and all(r.predicted == 0 for r in got)
    assert tox.score(make_docs([]), model).count() == 0


def test_without_labels_nothing_is_toxic(spark, case):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(case[1], empty)
    assert model is None
    assert {r.predicted for r in tox.score(case[1].limit(5), model).collect()} == {0}


def test_blocks_do_not_change_the_logit(case, monkeypatch):
    model = case[3]
    column = pa.array([t for _, t, _ in case[0][:30]])
    [(_, _, offsets, data)] = list(text_chunks(column))
    whole = model.logits(tox.hash_words(offsets, data))
    monkeypatch.setattr(tox, "BLOCK_WORDS", 7)
    assert np.allclose(whole, model.logits(tox.hash_words(offsets, data)), atol=1e-4)

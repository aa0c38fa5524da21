from __future__ import annotations

import random

import numpy as np
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import quality as q


def rows_of(rng, n):
    words = ["".join(rng.choice(["ri", "ver", "town", "lo", "mar"]) for _ in range(rng.randint(1, 3))) for _ in range(300)] + ["the", "of", "and", "in"] * 30
    out = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        kind = k % 10
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x for x in w[:8] for _ in range(12)]
        elif kind == 2:
            w = [x + rng.choice(["***", "###", "$$$"]) for x in w]
        out.append((k, " ".join(w), int(kind > 2)))
    return out


def test_scores_part_good_from_bad(make_docs):
    rows = rows_of(random.Random(1), 600)
    docs = make_docs([r[:2] for r in rows])
    model = q.fit(docs)
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    kept = [got[i].keep for i, _, good in rows if good]
    dropped = [not got[i].keep for i, _, good in rows if not good]
    assert np.mean(kept) > 0.98 and np.mean(dropped) > 0.95
    accuracy = model.labels.accuracies()
    assert accuracy["capitals"] > 0.9 and accuracy["sign runs"] > 0.9
    assert all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 and len(r.votes) == len(q.LABELLERS) for r in got.values())


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(2)
    n = 20_000
    good = rng.random(n) < 0.8
    v = np.zeros((n, len(q.LABELLERS)), np.int64)
    right = [0.95, 0.9, 0.85, 0.9, 0.8, 0.75, 0.9, 0.85]
    for k, p in enumerate(right):
        votes = rng.random(n) < 0.9
        v[votes, k] = np.where((rng.random(votes.sum()) < p) == good[votes], 1, -1)
    code, count = np.unique(q._codes(v), return_counts=True)
    model = q.LabelModel(code, count)
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert list(model.accuracies().values()) == pytest.approx(right, abs=0.03)
    assert ((model.posterior(v) > 0.5) == good).mean() > 0.97


def test_defined_cases(make_docs):
    assert q.fit(make_docs([])) is None
    docs = make_docs([(1, None), (2, ""), (3, "###"), (None, "a b"), (5, "x " * 50_000), (5, "x " * 50_000)])
    model = q.fit(docs)
    got = q.score(docs, model).collect()
    assert len(got) == 6 and {r.doc_id for r in got} == {1, 2, 3, None, 5}
    assert len({(r.votes, r.score) for r in got if r.doc_id == 5}) == 1
    assert q.score(make_docs([]), model).count() == 0

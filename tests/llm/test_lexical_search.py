from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
                        for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id int")


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(n=700, seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "日本", "x1", "THE"]
    topics = [rnd.sample(words, 40) for _ in range(12)]
    rows = [(k, " ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(1, 60)))) for k in range(n)]
    rows += [(2000 + k, rows[3][1]) for k in range(90)]  # ties
    rows += [(5000, None), (5001, ""), (5002, " \x7f ..."), (None, rows[4][1]), (None, "w1 w2"), (3, rows[3][1]), (5003, "w7 " * 5000), (5004, "été w9\nÉTÉ_w9-W9")]
    return rows


ITEMS = [(0, "w1 w2 w3 w4 W5 w5"), (1, "the Été 日本 nothere"), (2, None), (3, ""), (4, "nowhere"), (None, "w7 w8"), (0, "w9"), (6, " ".join(f"w{k}" for k in range(200)))]


def test_equals_brute_force(spark, make_docs, make_items, monkeypatch):
    monkeypatch.setattr(lexical_search, "PARTITION_ROWS", 300)
    monkeypatch.setattr(lexical_search, "PIECE", 32)
    docs = corpus()
    items = ITEMS + [(10 + k, docs[k * 7][1]) for k in range(30)]
    assert got(lexical_search.rank_documents(make_docs(docs), make_items(items))) == brute(docs, items)


def test_blocks_of_queries_and_small_top(spark, make_docs, make_items, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 4)
    docs = corpus(60)
    assert got(lexical_search.rank_documents(make_docs(docs), make_items(ITEMS), top=3)) == brute(docs, ITEMS, 3)


def test_empty_tables(spark, make_docs, make_items):
    assert lexical_search.rank_documents(make_docs([]), make_items(ITEMS)).count() == 0
    assert lexical_search.rank_documents(make_docs([(1, "w1")]), make_items([])).count() == 0
    assert lexical_search.rank_documents(make_docs([(1, None)]), make_items(ITEMS)).count() == 0


def test_centroids_are_distinct_rows(spark, make_docs):
    """A row that repeats gives one centroid, each of them with its terms."""
    docs = [(k, f"w{k % 40} w{k % 7}") for k in range(1500)] + [(3, "w3 w3")] * 600
    queries = lexical_search.Queries([" ".join(f"w{k}" for k in range(40))])
    forward = lexical_search.forward_rows(make_docs(docs), queries)
    w = lexical_search.np.ones(40, lexical_search.np.int64)
    got = lexical_search._centroids(forward, w, len(docs), 2 * len(docs))
    assert got.shape == (40, len(docs) // lexical_search.PIECE)
    assert lexical_search.np.allclose((got ** 2).sum(0), 1)


def test_summaries_bound_every_document_and_blocks_are_skipped():
    """A block's bound is no less than any of its documents' scores, and some blocks are not opened."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices([f"{'ab'[k % 2]}{j}" for j in range(40)], k=30)) for k in range(64)]
    queries = lexical_search.Queries([" ".join(rnd.sample([f"a{j}" for j in range(40)], 12) + [f"b{k}"]) for k in range(8)])
    bags = []
    for t in texts:
        data = pa.array([t])
        for _, _, offsets, raw in lexical_search.text_chunks(data):
            h, length, _ = lexical_search.spans(offsets, raw)
            number = queries.find(h, length)
            bags.append(Counter(number[number >= 0].tolist()))
    held = [(sorted(b), [1000 * b[t] // (b[t] + 1) for t in sorted(b)]) for b in bags if b]
    ids = list(range(len(held)))
    row = lexical_search._piece_row(ids, [pa.array(t).to_numpy().astype("<i4") for t, _ in held],
                                    [pa.array(v).to_numpy().astype("<i4") for _, v in held], queries)
    block, coordinate, summary = (lexical_search.np.frombuffer(v, "<i4") for v in row[5:])
    local = sorted({t for ts, _ in held for t in ts})
    most = {(local[b], local[c]): s for b, c, s in zip(block, coordinate, summary)}
    for q in range(len(queries)):
        mine = [t for t in queries.of(q).tolist() if t in local]
        for ts, vs in held:
            have = dict(zip(ts, vs))
            for t in set(mine) & set(ts):
                assert all(most[t, u] >= have[u] for u in mine if u in have)
    w = lexical_search.np.ones(len(queries.hash), lexical_search.np.int64) * 10
    best, work = lexical_search._Best(len(queries), 3), {"skipped": 0, "opened": 0}
    for _ in range(2):
        lexical_search._search_piece(queries, w, best, row, work)
    assert work["skipped"] > 0

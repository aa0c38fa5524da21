"""The SQL of the two joins on pairs equals brute force where the given tables hold few links: chains, groups, odd rows."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import test_jaccard_join as jaccard
import test_pq_dedup as vectors

from shelfwise.llm.queries import ORACLE_SQL


def rows_of(key, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return sorted(con.execute(ORACLE_SQL[key]).fetchall(), key=str)


def test_vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal(24)
    rows = [(k, rng.standard_normal(24).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100 + k, vectors.near(rng, base, 0.05 + 0.25 * (k % 3))) for k in range(60)]
    rows += [(50, rows[3][1]), (None, rows[4][1]), (None, None), (300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] * 24),
             (304, [None] + [1.0] * 23), (305, [float("inf")] + [1.0] * 23), (306, [1.0, 0.0]), (307, [2.0, 0.0])]
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    want = vectors.brute(rows)
    assert sum(r[1] for r in want) > 500
    assert rows_of("op5_embedding_near_dedup", embeddings=table) == want


def test_documents():
    rows = jaccard.corpus(random.Random(4)) + [(None, "a b c d e f"), (7001, "a b c d e f"), (7002, None), (7003, ""), (7004, " \t\n"),
                                               (7005, "One two"), (7006, "one\x0bTWO"), (7007, "\u00c9t\u00e9\u00a0x"), (7008, "\u00e9t\u00e9\u00a0x")]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    want = jaccard.brute(rows)
    assert len({r[2] for r in want}) < len(want) - 60
    assert rows_of("op9_ngram_jaccard_join", documents=table) == want


def test_empty_tables():
    assert rows_of("op5_embedding_near_dedup", embeddings=pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))})) == []
    assert rows_of("op9_ngram_jaccard_join", documents=pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})) == []

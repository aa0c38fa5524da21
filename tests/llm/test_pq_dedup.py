from __future__ import annotations

import numpy as np
import pytest

from shelfwise.llm import pq_dedup as pq

SCHEMA = "vec_id long, embedding array<float>, label int, id long, weight string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    x = [None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else pq.unit(np.array([v], np.float32))[0] for _, v in rows]
    n, group = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
                n[a] += 1
                n[b] += 1
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, n[k], low.get(find(k)), None if i is None or find(k) not in low else i == low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def near(rng, base, noise):
    return (base + noise * rng.standard_normal(len(base))).astype(np.float32).tolist()


@pytest.mark.parametrize("blocks", [(2048, 4096), (16, 16)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(32).astype(np.float32).tolist()) for k in range(120)]
    base = rng.standard_normal(32)
    rows += [(1000 + k, near(rng, base, 0.05 + 0.25 * (k % 3))) for k in range(120)]
    rows += [(500 + k, near(rng, np.array(rows[k][1]), 0.2)) for k in range(60)]
    rows += [(2000 + k, rows[5][1]) for k in range(15)] + [(3000, [2 * v for v in rows[5][1]])]
    monkeypatch.setattr(pq, "LIST_SIZE", 20)
    monkeypatch.setattr(pq, "MEMBER_BLOCK", blocks[0])
    monkeypatch.setattr(pq, "QUERY_BLOCK", blocks[1])
    got = sorted((tuple(r) for r in pq.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == brute(rows)  # recall 1.0


def test_defined_cases(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [None, 1.0, 0.0]),
            (8, [float("inf"), 1.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, [1e-30, 0.0, 5e-31])]
    got = sorted((tuple(r) for r in pq.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert pq.near_duplicates(vectors(spark, [])).count() == 0
    assert pq.near_duplicates(vectors(spark, [(1, v)])).collect()[0].kept is True
    one = pq.near_duplicates(vectors(spark, [(1, v), (1, v), (None, v)])).collect()
    assert sorted((r.n_links, r.component_id) for r in one) == [(2, 1)] * 3


def test_missing_and_repeated_ids_link_by_vector(spark):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal(24), rng.standard_normal(24)
    near_a, near_b = near(rng, a, 0.05), near(rng, b, 0.05)
    a, b = a.astype(np.float32).tolist(), b.astype(np.float32).tolist()
    x = [1.0] + [0.0] * 23
    bridge = [float(np.cos(0.4)), float(np.sin(0.4))] + [0.0] * 22
    far = [float(np.cos(0.8)), float(np.sin(0.8))] + [0.0] * 22
    rows = [(1, a), (1, b), (2, near_a), (3, near_b),  # one id, two vectors: each links with its own copy only
            (7, x), (None, bridge), (9, far),  # a row without id joins two others
            (20, near(rng, np.array(near_a), 0.01)), (20, near_a),  # one id, two near vectors
            (None, [0.0, 0.0, 1.0] + [0.0] * 21), (None, [0.0, 0.0, 1.0, 0.1] + [0.0] * 20)]
    got = sorted((tuple(r) for r in pq.near_duplicates(vectors(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_estimates_never_miss_within_the_error():
    rng = np.random.default_rng(3)
    x = pq.unit(rng.standard_normal((400, 24)))
    q = pq.Quantiser(x, 5)
    lists = q.probes(x)[:, 0]
    codes, error = q.encode(x, lists)
    for number in range(len(q.centroids)):
        m = lists == number
        assert (q.estimate(x, number, codes[m]) + error[m] >= x @ x[m].T - 1e-4).all()


def _reference(x, threshold=0.9):
    """Links of every vector and the smallest number it is connected to, by all products."""
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(x), 500):
        close = x[at:at + 500] @ x.T >= threshold
        close[np.arange(len(close)), at + np.arange(len(close))] = False
        n[at:at + 500] = close.sum(1)
        for i, j in zip(*np.nonzero(close)):
            a, b = find(at + i), find(j)
            root[max(a, b)] = min(a, b)
    return n, [find(k) for k in range(len(x))]


def test_no_link_is_lost_between_many_lists_of_one_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    x = rng.standard_normal((3000, 64))
    x[::3] = base + 0.31 * rng.standard_normal((1000, 64))  # a third in one group of distinct near copies, some links just under 0.9
    x[1::30] = x[2::30] + 0.3 * rng.standard_normal((100, 64))
    x = x.astype(np.float32)
    monkeypatch.setattr(pq, "LIST_SIZE", 30)  # 100 lists, a third of them inside the group
    monkeypatch.setattr(pq, "MEMBER_BLOCK", 700)
    monkeypatch.setattr(pq, "QUERY_BLOCK", 900)
    got = pq.near_duplicates(vectors(spark, list(enumerate(x.tolist())))).orderBy("vec_id").collect()
    n, root = _reference(pq.unit(x))
    assert 0 < sum(n[::3]) < 999_000
    assert [(r.n_links, r.component_id) for r in got] == list(zip(n.tolist(), root))


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_every_pair_over_the_threshold_is_probed_from_a_side(threshold):
    rng = np.random.default_rng(6)
    x = pq.unit(np.concatenate([rng.standard_normal((600, 24)), rng.standard_normal(24) + 0.3 * rng.standard_normal((400, 24))]))
    q = pq.Quantiser(x, 60, 7, threshold)
    home = q.probes(x)[:, 0]
    met = q.probed(x, home, np.arange(len(q.centroids)))[:, home]
    linked = x @ x.T >= threshold
    assert (linked <= (met | met.T)).all()
    apart = home[:, None] != home
    assert not (met & met.T & apart).any() and not met.all()

from __future__ import annotations

import random
import re

import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def corpus(rng, n=160):
    """Unrelated texts, a shared passage, a large group of near copies, chains, exact copies, short and odd texts."""
    words = [f"w{k}" for k in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, base = text(30), text(80)
    out = []
    for k in range(n):
        kind = k % 8
        if kind < 2:
            w = text(rng.randint(5, 120))
        elif kind == 2:
            w = text(rng.randint(3, 60)) + passage + text(rng.randint(0, 60))
        elif kind < 6:
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 6:
            w = text(rng.randint(0, 6))
        else:
            w = passage[:rng.randint(20, 30)]
        out.append((k * 3, " ".join(w) if rng.random() < 0.8 else "\t".join(w).upper()))
    out += [(9000 + k, out[rng.randrange(n)][1]) for k in range(20)]
    return out


@pytest.mark.parametrize("seed,rare", [(1, 32), (2, 4), (3, 2)])
def test_components_equal_brute_force(make_docs, monkeypatch, seed, rare):
    rows = corpus(random.Random(seed))
    monkeypatch.setattr(jj, "RARE", rare)  # low: the frequent levels do the work
    monkeypatch.setattr(jj, "BUCKET", 500)
    # (the matching side keeps its usual bound; what the indexing side marks is frequent for both)
    got = sorted([tuple(r) for r in jj.shingle_components(make_docs(rows)).collect()], key=str)
    assert got == brute(rows)


def test_rows_without_id_link_and_bridge(make_docs):
    words = [f"w{k}" for k in range(100)]
    ends = [words[:], words[:7] + [f"x{k}" for k in range(6)] + words[13:], words[:80] + [f"y{k}" for k in range(6)] + words[86:]]
    both = words[:7] + [f"x{k}" for k in range(6)] + words[13:80] + [f"y{k}" for k in range(6)] + words[86:]
    rows = [(5, " ".join(ends[1])), (9, " ".join(ends[2])), (None, " ".join(ends[0])), (None, " ".join(both[:50] + ["z"] + both[50:])),
            (None, "alone " * 8), (None, "p q r s t u v"), (None, "p q r s t u v")]
    got = sorted([tuple(r) for r in jj.shingle_components(make_docs(rows)).collect()], key=str)
    assert got == brute(rows)
    assert len({c for i, _, c in got if i in (5, 9)}) == 1


def test_copies_that_are_connected_make_no_pairs(make_docs, monkeypatch):
    """What the index makes grows with the texts, not with the pairs of a group."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]

    def rows(n):
        out = []
        for k in range(n):
            w = list(base)
            w[rng.randrange(120)] = f"own{k}"
            out.append((k, " ".join(w)))
        return out

    made = {}
    for n in (12, 30):
        calls = []
        real = jj.materialize
        monkeypatch.setattr(jj, "materialize", lambda df, label: calls.append((label, real(df, label))) or calls[-1][1])
        assert len({r["component_id"] for r in jj.shingle_components(make_docs(rows(n))).collect()}) == 1
        monkeypatch.setattr(jj, "materialize", real)
        made[n] = sum(df.where(f"kind = {jj.PAIR}").count() for label, df in calls if label.startswith("join-found"))
    assert made[30] <= 30 and made[12] <= 12


def test_defined_cases(make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b"), (6, "a b"), (None, "a b c d e f g"),
            (8, "a b c d e f g"), (9, "x " * 3000)]
    got = sorted([tuple(r) for r in jj.shingle_components(make_docs(rows)).collect()], key=str)
    assert got == brute(rows)
    assert jj.shingle_components(make_docs([])).count() == 0


def test_linked_sets_share_a_combination_key():
    import numpy as np
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 90)
        pool = [rng.getrandbits(63) for _ in range(2 * n + 4)]
        x = set(pool[:n])
        y = set(x)
        for _ in range(rng.randint(0, max(1, n // 5))):
            if rng.random() < 0.5 and len(y) > 1:
                y.discard(rng.choice(sorted(y)))
            else:
                y.add(rng.choice(pool))
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = (jj.combination_keys(np.array(sorted(s), np.uint64)) for s in (x, y))
            assert len(np.intersect1d(a, b)), (len(x), len(y), len(x & y))


def halves(rng, n):
    """Texts that share about half of their words with each other, and a few near copies of some of them."""
    base = [f"w{k}" for k in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(4, 9)):
            w[rng.randrange(120)] = f"own{rng.randrange(60)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [2_000, 40_000, 1_000_000])
def test_unlinked_relatives_equal_brute_force_in_any_blocks(make_docs, monkeypatch, block):
    rows = halves(random.Random(3), 90) + corpus(random.Random(4), 40)
    monkeypatch.setattr(jj, "RARE", 2)
    monkeypatch.setattr(jj, "BUCKET", 2_000)
    monkeypatch.setattr(jj, "BLOCK", block)
    got = sorted([tuple(r) for r in jj.shingle_components(make_docs([(k, t) for k, (_, t) in enumerate(rows)])).collect()], key=str)
    want = brute([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == want
    assert len({c for i, _, c in want if i < 90}) > 20  # most relatives are not linked


def combination_postings(sets):
    """A bucket of combination keys; every set is a component of its own and all its tokens are frequent."""
    import numpy as np
    import pyarrow as pa

    keys = [jj.combination_keys(s) for s in sets]
    times = [len(k) for k in keys]
    cls = np.repeat(np.arange(len(sets), dtype=np.int64), times)
    size = np.repeat(np.array([len(s) for s in sets], np.int64), times)
    columns = {"key": np.concatenate(keys), "class": cls, "size": size, "frequent": size, "component": cls}
    return pa.table({"bucket": pa.array([0], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()})


def test_holders_of_a_key_make_a_row_each_not_a_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    made = {n: jj._crossing(combination_postings([np.sort(np.append(common, rng.integers(1, 1 << 62, 60).astype(np.uint64))) for _ in range(n)])).num_rows
            for n in (40, 200)}
    assert 20 <= made[40] < 40 and made[200] < 200


def test_a_shared_passage_makes_a_list_once_a_bucket():
    """Twenty texts with one passage of two hundred tokens: one list of holders, not a row for each of 190 pairs."""
    import numpy as np
    import pyarrow as pa

    token = np.random.default_rng(2).integers(1, 1 << 62, 200).astype(np.uint64)
    table = {"token": np.repeat(token, 20), "class": np.tile(np.arange(20, dtype=np.int64), 200), "size": np.full(4000, 900, "<i4"),
             "heavy": np.zeros(0, np.int64), "times": np.zeros(0, "<i8"), "member": np.zeros(0, np.int64), "component": np.zeros(0, np.int64)}
    found = jj._match(pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in table.items()}))
    assert found.num_rows == 1 and found.column("n").to_pylist() == [200]
    pairs = pa.Table.from_batches(list(jj._pairs(iter(found.select(["holders", "n"]).to_batches()))))
    assert pairs.num_rows == 190 and set(pairs.column("n").to_pylist()) == {200}


def test_shared_tokens_equal_plain_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    often, seldom = rng.integers(1, 1 << 62, 30).astype(np.uint64), rng.integers(1, 1 << 62, 3000).astype(np.uint64)

    def some(n):
        sets = [np.unique(np.concatenate([rng.choice(often, rng.integers(0, 25)), rng.choice(seldom, rng.integers(1, 12))])) for _ in range(n)]
        return sets, (np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))

    (x, a), (y, b) = some(150), some(260)
    for left, right, one, two in ((x, y, a, b), (x, x, a, a)):
        got = np.concatenate([m for _, m in jj._shared_tokens(one, two, 37)])
        assert got.tolist() == [[len(np.intersect1d(s, t)) for t in right] for s in left]

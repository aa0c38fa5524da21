from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from shelfwise.llm import conversation_trie as trie


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, head string, g int")


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def own_turns(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5(role or "", text or ""), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(source, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), set()).add(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(x) == len(p) + 1 and x[:len(p)] == p for x in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(prefix))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def sample(n=60, seed=2):
    rnd = random.Random(seed)
    texts = ["", "a", "é", "long turn", "b"]
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(texts)))
    rows += [(200, None, "user", "no number"), (200, 0, None, None), (200, 0, "user", "tie"), (200, 0, "bot", "tie"), (200, 0, "bot", "tie"),
             (None, 0, "user", "lost"), (203, 0, "user", "x"), (-3, 0, "user", "minus"), (-10, 1, "user", "minus")]
    rows += [(300 + c, t, "user", f"shared {t}") for c in range(40) for t in range(12)]  # copies
    rows += [(400 + c, t, "user", f"shared {t}" if t < 9 else f"own {c}") for c in range(40) for t in range(10)]  # a long common start
    return rows


@pytest.mark.parametrize("burst", [40, 10_000])
def test_rebuilt_conversations_equal_brute_force(spark, burst):
    rows = sample()
    assert got(trie.prefix_trie(trie.rebuilt(make(spark, rows)), burst=burst)) == brute(rebuild(own_turns(rows)))


@pytest.mark.parametrize("burst", [30])
def test_plain_conversations_with_prefixes_of_each_other(spark, burst):
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(c % 13 + 1)] + [(c, t, "bot", f"turn {t % 3}") for c in range(40, 60) for t in range(c - 38)]
    convs = trie.conversations(make(spark, rows)).select("conv_id", "turns")
    assert got(trie.prefix_trie(convs, burst=burst)) == brute(own_turns(rows))


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "hidden"), (c - c % 5 + 5, 0, "user", "seen")]
    found = got(trie.prefix_trie(trie.rebuilt(make(spark, rows))))
    assert found == brute(rebuild(own_turns(rows))) and found[0][3] == 2 or found[-1][3] == 2


def test_one_conversation_longer_than_a_container_and_an_empty_table(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(400)] + [(10, 0, "user", "t0")]
    convs = trie.conversations(make(spark, rows)).select("conv_id", "turns")
    assert got(trie.prefix_trie(convs, burst=50)) == brute(own_turns(rows))
    assert trie.prefix_trie(trie.rebuilt(make(spark, []))).count() == 0


def test_two_batches_of_one_container(spark):
    """Copies and containers may be cut by Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = sample(30)
        assert got(trie.prefix_trie(trie.rebuilt(make(spark, rows)))) == brute(rebuild(own_turns(rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

from __future__ import annotations

import hashlib
import random

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import fingerprints as fp


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        own, other, after = (fp.Fingerprint(t.encode()) for t in (text, changed, following))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.text(), other.text(),
                    round(own.likeness(other), 9), round(own.likeness(after), 9)))
    return sorted(out, key=str)


def test_matches_brute_force_over_many_ranges(make_docs, monkeypatch):
    rng = random.Random(3)
    rows = [(k * 7 - 50, " ".join(rng.choice(["alpha", "béta", "gamma", "δelta", "12"]) for _ in range(rng.randrange(0, 120))))
            for k in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "x" * 50_000), (5003, rows[0][1]), (-44, rows[3][1])]
    monkeypatch.setattr(fp, "RANGE_ROWS", 20)
    got = [tuple(r) for r in fp.fingerprints(make_docs(rows)).collect()]
    got = sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got], key=str)
    assert got == brute(rows)


def test_ties_nulls_single_and_empty(make_docs):
    rows = [(None, "a b c"), (1, "same"), (1, "same"), (2, None)]
    got = sorted([tuple(r)[:5] for r in fp.fingerprints(make_docs(rows)).collect()], key=str)
    assert got == sorted([r[:5] for r in brute(rows)], key=str)
    one = fp.fingerprints(make_docs([(9, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    assert fp.fingerprints(make_docs([])).count() == 0


def test_boundaries_shift_with_the_text():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    plain, moved = fp.Fingerprint(text.encode()), fp.Fingerprint(("inserted " + text).encode())
    assert plain.likeness(moved) > 0.95
    assert fp.boundaries(__import__("numpy").frombuffer(text.encode(), "u1"))[-1] == 5000

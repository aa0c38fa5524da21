from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer_path())


ODD = ["", "don't stop", "naïve Σίσυφος ΣΑΣ x", "<|endoftext|> a<|startoftext|>b", "é é ́x", "日本語 テキスト", "\x1c a\x85b c\x00d",
       "İstanbul ǅ ﬁ", "123 4a5 x_y", "a.b. c., d?", "ªº ²³ \xa0x", "THE!! x*** y### z&&&", "''''", "a" * 300, "wörter, Ünd!"]


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    syllables = ["an", "the", "ing", "é", "ß", "or", "ST"]
    texts = ODD + [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 8))) + rng.choice(["", ".", ",", "!!"])
                            for _ in range(80)) for _ in range(40)]
    enc = packing.CachedEncoder(packing.default_tokenizer_path(), cache_words=50)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(make_docs, tokenizer):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 300)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 5000), (3, rows[3][1]), (None, "x")]
    got = packing.pack(make_docs(rows), capacity=256, steps=40).collect()
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 256)):
            raw = np.array(ids[at:at + 256], "<u4").tobytes()
            want.append((i, p, at, len(raw) // 4, zlib.crc32(raw)))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    used = check_layout(got, 256)
    assert used <= 1.05 * sum(w[3] for w in want) / 256 + 2
    assert packing.pack(make_docs([])).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(7)
    hist = {}
    for _ in range(30_000):
        n = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        hist[n] = hist.get(n, 0) + 1
    layout = packing.plan(hist, 2048, 60)
    bound = -(-sum(k * v for k, v in hist.items()) // 2048)
    assert bound <= layout.n_sequences <= 1.005 * bound + 2
    with pytest.raises(ValueError):
        packing.plan({3000: 1}, 2048)


def test_pricing_finds_the_best_configuration():
    lengths, weights = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.8])
    best = max((a * .3 + b * .55 + c * .8, (a, b, c)) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    got = packing._price(weights, lengths, np.array([9, 9, 9]), 17)
    assert sum(weights[k] * a for k, a in got.items()) == pytest.approx(best[0])


def test_program_covers_every_length():
    rng = random.Random(5)
    lengths = np.array(sorted(rng.sample(range(1, 300), 120)))
    counts = np.array([rng.randint(1, 400) for _ in lengths])
    covered = np.zeros(len(lengths))
    for config, x in packing.solve_lp(lengths, counts.astype(float), 300, 40):
        assert sum(a * lengths[k] for k, a in config.items()) <= 300
        for k, a in config.items():
            covered[k] += a * x
    assert np.allclose(covered, counts)


def test_most_tokens_are_placed_by_the_program(monkeypatch):
    rng = random.Random(6)
    lengths = np.arange(1, 400)
    counts = np.array([rng.randint(5, 60) for _ in lengths])
    left_over = []
    plain = packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda le, left, cap: left_over.append(int(left @ le)) or plain(le, left, cap))
    layout = packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 400, 100)
    assert max(left_over) <= 0.4 * (counts @ lengths)
    bound = max(-(-int(counts @ lengths) // 400), int(counts[lengths > 200].sum()))  # two of over half never share one
    assert bound <= layout.n_sequences <= 1.01 * bound + 1


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer_path().replace(packing.TOKENIZER_FILE, "byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.CachedEncoder(path).ids(ODD)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in ODD]


def test_word_cache_stays_bounded_when_the_reader_leaves_first(tokenizer):
    """Readers that pair texts with ids leave after the last text's ids, as ``pieces`` does."""
    limit, letters = 60, "abcdefghijklmnopqrstuvwxyz"
    enc = packing.CachedEncoder(packing.default_tokenizer_path(), cache_words=limit)
    words = [a + b + c for a in letters for b in letters for c in "xyz"]
    for lo in range(0, len(words), 20):
        texts = [" ".join(words[lo:lo + 10]), " ".join(words[lo + 10:lo + 20]), words[0]]
        got = [np.frombuffer(ids, "<u4").tolist() for _, ids in zip(range(len(texts)), enc.ids(texts))]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.young) < limit and len(enc.old) < limit + 22

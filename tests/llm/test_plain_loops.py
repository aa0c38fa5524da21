"""The learned operators' queries against plain loops over one text at a time: same words, features, passes and votes, without numpy's whole-batch forms."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from test_langid import rows_of as language_rows
from test_quality import rows_of as quality_rows
from test_toxicity import texts as toxic_texts

from shelfwise.llm import langid, quality, toxicity
from shelfwise.llm.common import SpanHasher

ODD = [None, "", " .,;", "a", "Zwölf Äpfel für den Müller", "ÉTÉ où l'été", "the the the", "日本語 текст", "x" * 3000, "stop 12 34"]


def _hash(data: bytes) -> int:
    return int(SpanHasher(np.frombuffer(data, np.uint8))(np.array([0]), np.array([len(data)]))[0])


def _folded(text) -> bytes:
    """A-Z and the Latin-1 capitals of UTF-8 in lower case, byte by byte."""
    raw, out = (text or "").encode(), bytearray()
    for k, c in enumerate(raw):
        if 65 <= c <= 90:
            c += 32
        elif k and raw[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            c += 32
        out.append(c)
    return bytes(out)


# ---------------------------------------------------------------- op3

def _mix(x: int) -> int:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor % (1 << 64)
    return x ^ x >> 33


def _toxic_score(model, text) -> float:
    words = re.findall(rb"[\x80-\xffa-z0-9]+", _folded(text))
    if not words:
        return 0.0
    shift = 64 - int(math.log2(model.buckets))
    vectors = []
    for w in words:
        ids = [_hash(w) >> shift] + [_mix((_hash(w[:n]) + k + 1) % (1 << 64)) >> shift for k, n in enumerate(toxicity.STEMS)]
        vectors.append(sum(model.embedding[i].astype(float) for i in ids))
    blank = [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
    line = blank + vectors + blank
    z, at = model.out_bias, 0
    for bank in model.filters:
        for f in range(bank.shape[2]):
            best = 0.0
            for p in range(len(blank) + len(vectors)):
                best = max(best, sum(line[p + j] @ bank[j, :, f] for j in range(len(bank)) if p + j < len(line)) + model.bias[at])
            z += best * model.out[at]
            at += 1
    counts = [sum(w.decode("utf-8", "replace") in own for w in words) for own in map(set, toxicity.FUNCTION_WORDS.values())]
    lang = counts.index(max(counts)) if max(counts) else len(counts)
    z += math.log(toxicity.DECISION / (1 - toxicity.DECISION)) - model.thresholds.get(lang, model.thresholds[-1])
    return 1 / (1 + math.exp(-max(-60, min(60, z))))


def test_toxicity_scores(spark):
    rows = toxic_texts(random.Random(6), 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    probe = [(k, t) for k, t in enumerate([t for _, t, _ in rows[:25]] + [t for t in ODD if t is None or len(t) < 100])]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    for k, text in probe:
        want = _toxic_score(model, text)
        assert got[k].score == pytest.approx(want, abs=2e-4), text
        assert abs(want - toxicity.DECISION) < 2e-4 or got[k].predicted == int(want >= toxicity.DECISION)
    assert {r.predicted for r in got.values()} == {0, 1}


# ---------------------------------------------------------------- op8

def _letter(c: int) -> bool:
    return c >= 128 or 97 <= c <= 122


def _language_features(text) -> dict[int, float]:
    data = _folded(text)
    plain = [c if _letter(c) else 32 for c in data]
    groups: list[dict[int, int]] = []
    for width, size in zip((1, 2, 3), langid.SIZES):
        counts: dict[int, int] = {}
        for k in range(len(plain) - width + 1):
            if _letter(data[k]) or _letter(data[k + width - 1]):
                gram = 0
                for c in plain[k:k + width]:
                    gram = gram << 8 | c
                bucket = gram if width == 1 else (gram * 0x9E3779B1) % (1 << 32) >> 32 - int(math.log2(size))
                counts[bucket] = counts.get(bucket, 0) + 1
        groups.append(counts)
    counts = {}
    for w in re.findall(rb"[\x80-\xffa-z]+", data):
        bucket = _hash(w) >> 64 - int(math.log2(langid.SIZES[3]))
        counts[bucket] = counts.get(bucket, 0) + 1
    groups.append(counts)
    out, at = {}, 0
    for size, counts in zip(langid.SIZES, groups):
        for bucket, n in counts.items():  # square roots, scaled to length one: the sum of squares of roots is the sum
            out[at + bucket] = math.sqrt(n) / math.sqrt(sum(counts.values())) / 2
        at += size
    return out


def _language(model, text) -> tuple[str, float]:
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = _language_features(text)
    margin = lambda w: sum(v * w[k] for k, v in x.items()) + w[-1]
    squash = lambda m: 1 / (1 + math.exp(-max(-50, min(50, 3 * m))))
    tops = [margin(w) for w in model.family_weights]
    family = tops.index(max(tops))
    sure = squash(sorted(tops)[-1] - sorted(tops)[-2]) if len(tops) > 1 else 1.0
    members = model.members[family]
    won, lead = [0.0] * len(members), [math.inf] * len(members)
    for (i, j), w in model.pair_weights[family].items():
        m = margin(w)
        won[i] += (m > 0) + 1e-3 * math.tanh(m)
        won[j] += (m <= 0) - 1e-3 * math.tanh(m)
        lead[i], lead[j] = min(lead[i], m), min(lead[j], -m)
    best = won.index(max(won))
    return members[best], sure * (squash(lead[best]) if len(members) > 1 else 1.0)


def test_languages(spark):
    rows = language_rows(random.Random(7), 300)
    model = langid.fit(spark.createDataFrame([(i, t, v) for i, t, v, _ in rows], "doc_id long, text string, lang string"))
    assert len(model.families) == 2 and [len(m) for m in model.members] == [2, 2]
    probe = list(enumerate([t for _, t, _, _ in rows[:60]] + ODD))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    for k, text in probe:
        lang, sure = _language(model, text)
        assert (got[k].lang_pred, got[k].score) == (lang, pytest.approx(sure, abs=1e-4)), text


# ---------------------------------------------------------------- op1

def _plain_em(patterns: list[tuple[tuple[int, ...], int]]):
    """Prior, chances of each answer per class and posteriors, a pattern and a labeller at a time."""
    good = [1 / (1 + math.exp(-(1.5 + 0.5 * sum(a > 0 for a in p) - 4.0 * sum(a < 0 for a in p)))) for p, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(quality.EM_ROUNDS):
        prior = min(1 - 1e-3, max(1e-3, sum(n * g for (_, n), g in zip(patterns, good)) / total))
        chance = {}
        for side in (0, 1):
            for k in range(len(quality.LABELLERS)):
                held = {-1: 1.0, 0: 1.0, 1: 0.2} if side == 0 else {-1: 0.2, 0: 1.0, 1: 1.0}
                for (p, n), g in zip(patterns, good):
                    held[p[k]] += n * (g if side else 1 - g)
                for answer in held:
                    chance[side, k, answer] = held[answer] / sum(held.values())
        before, good = good, []
        for p, _ in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(chance[1, k, a]) - math.log(chance[0, k, a]) for k, a in enumerate(p))
            good.append(1 / (1 + math.exp(-max(-50, min(50, z)))))
        if max(abs(a - b) for a, b in zip(good, before)) < quality.EM_CLOSE:
            break
    return prior, good


def test_label_model_and_scores(spark):
    rows = [r[:2] for r in quality_rows(random.Random(8), 300)] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs)
    got = quality.score(docs, model).collect()
    signs = {"-": -1, "0": 0, "+": 1}
    counts: dict[tuple[int, ...], int] = {}
    for r in got:
        p = tuple(signs[c] for c in r.votes)
        counts[p] = counts.get(p, 0) + 1
    prior, good = _plain_em(sorted(counts.items()))
    posterior = dict(zip(sorted(counts), good))
    assert model.labels.prior == pytest.approx(prior, abs=1e-6)
    assert len(got) == len(rows) and len(counts) > 5
    for r in got:
        assert r.posterior == pytest.approx(posterior[tuple(signs[c] for c in r.votes)], abs=1e-6)
        assert r.keep == (r.score >= quality.KEEP)
    alone = {}
    for i, t in rows[:20] + rows[-len(ODD):]:  # a text's score does not depend on its neighbours in a batch
        data = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.features(np.array([0, len(data)]), data)[0]
        alone[i] = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x.tolist(), model.weights.tolist()) if a)))
    for r in got:
        if r.doc_id in alone:
            assert r.score == pytest.approx(alone[r.doc_id], abs=1e-5)

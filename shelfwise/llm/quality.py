"""Text quality from overlapping heuristic labellers, without given labels.

Several labellers look at a text and vote good, bad or abstain. Expectation maximisation over the
votes of *all* texts estimates how accurate each labeller is; only counts per combination of votes
are needed for that (at most ``3 ** len(LABELLERS)`` rows), and they are summed up on the executors.
The posterior of a text's votes is its label. These labels train a linear scorer on hashed features
of a bounded sample of texts, which also tells apart texts whose votes are alike.

Two passes over the texts (votes, scores), without a shuffle of texts.

Defined cases: a NULL text is empty; texts without words
get no praise, and a score like any other. Repeated rows get equal results. Other columns are ignored. With no
rows, nothing is learned and the result is empty; where all votes are equal the scorer follows the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SpanHasher, fold_case, materialize, runs, sample_by_hash, sampled_texts, ship, text_chunks
from shelfwise.llm.toxicity import FUNCTION_WORDS, _word_hashes

LABELLERS = ("signs", "capitals", "repeats", "function words", "variety", "word length", "lone signs", "sign runs")
#: Bound of the training sample, hashed features per text, steps.
TRAIN_ROWS, FEATURES, EPOCHS, RATE = 4000, 4096, 15, 0.5
EM_ROUNDS, EM_CLOSE = 200, 1e-9
KEEP = 0.5
CHUNK, CHUNK_ROWS = 1 << 19, 500
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#$%&*!|<>{}[]\\^~=+_@"]] = True


def measures(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """What the labellers look at, a row per text."""
    n_rows = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], mask.cumsum()])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1)
    upper = total((data >= 65) & (data <= 90))
    lower = total((data >= 97) & (data <= 122))
    signs = total(_SIGNS[data])
    doubled = np.zeros(len(data), bool)
    doubled[1:] = _SIGNS[data[1:]] & (data[1:] == data[:-1])
    doubled = total(doubled)
    start, end, row = runs(data > 32, offsets)
    words = np.bincount(row, minlength=n_rows).astype(float)
    folded = fold_case(data)
    name = SpanHasher(folded)(start, end)
    same = np.zeros(len(name), bool)
    same[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    is_letter = (folded >= 128) | ((folded >= 97) & (folded <= 122))
    ls, le, lrow = runs(is_letter, offsets)
    stop = np.isin(SpanHasher(folded)(ls, le), _word_hashes(sorted({w for v in FUNCTION_WORDS.values() for w in v})))
    letters = np.concatenate([[0], is_letter.cumsum()])
    lone = letters[end] == letters[start]
    order = np.lexsort((name, row))
    new = np.ones(len(name), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n_rows)
    count = np.maximum(words, 1)
    parts = np.maximum(np.bincount(lrow, minlength=n_rows), 1)
    return np.stack([
        signs / size, upper / np.maximum(upper + lower, 1), np.bincount(row, weights=same, minlength=n_rows) / count,
        np.bincount(lrow, weights=stop, minlength=n_rows) / parts, distinct / np.maximum(np.minimum(count, 400), 1),
        np.bincount(row, weights=end - start, minlength=n_rows) / count,
        np.bincount(row, weights=lone, minlength=n_rows) / count, words, doubled / count], axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    """-1 bad, 0 abstain, 1 good: a column per labeller."""
    signs, capitals, repeats, function, variety, length, lone, words, doubled = m.T

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    never, some = np.zeros(len(m), bool), words >= 20
    return np.stack([
        vote(never, signs > 0.03), vote(never, (capitals > 0.5) & some), vote(never, repeats > 0.15),
        vote(function > 0.08, (function < 0.03) & some), vote((variety > 0.5) & some, (variety < 0.25) & some),
        vote(never, (length < 2) | (length > 16)), vote(never, lone > 0.1), vote(never, doubled > 0.2)], axis=1).astype(np.int8)


def _codes(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def _of_codes(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


class LabelModel:
    """Class prior and, per class, each labeller's chances of its three answers."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        v = _of_codes(code)
        weight = count.astype(float)
        total = max(weight.sum(), 1.0)
        answer = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
        # start: a complaint outweighs praise, since each labeller knows one kind of defect only
        good = 1 / (1 + np.exp(-(1.5 + 0.5 * (v > 0).sum(1) - 4.0 * (v < 0).sum(1))))
        for _ in range(EM_ROUNDS):
            before = good
            self.prior = np.clip((weight @ good) / total, 1e-3, 1 - 1e-3)
            chance = []
            for share in (1 - good, good):
                w = weight * share
                # a little of the start's belief: a labeller is right more often than wrong
                belief = np.array([1.0, 1.0, 0.2]) if len(chance) == 0 else np.array([0.2, 1.0, 1.0])
                p = np.einsum("r,rlk->lk", w, answer) + belief
                chance.append(p / p.sum(1, keepdims=True))
            self.bad, self.good = np.log(chance[0]), np.log(chance[1])
            good = self.posterior(v)
            if np.abs(good - before).max(initial=0.0) < EM_CLOSE:
                break

    def posterior(self, v: np.ndarray) -> np.ndarray:
        pick = v.astype(np.int64) + 1
        labeller = np.arange(v.shape[1])
        z = np.log(self.prior / (1 - self.prior)) + (self.good[labeller, pick] - self.bad[labeller, pick]).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        right = self.prior * np.exp(self.good[:, 2]) + (1 - self.prior) * np.exp(self.bad[:, 0])
        wrong = self.prior * np.exp(self.good[:, 0]) + (1 - self.prior) * np.exp(self.bad[:, 2])
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def features(offsets: np.ndarray, data: np.ndarray, m: np.ndarray | None = None) -> np.ndarray:
    """Hashed byte triples and repeated neighbours, square-rooted and scaled to length one, and a constant."""
    n_rows = len(offsets) - 1
    shape = fold_case(data)
    capital = (data >= 65) & (data <= 90)
    shape = np.where(capital, 1, shape).astype(np.uint32)  # capitals are one class
    shape = np.where((data >= 48) & (data <= 57), 2, shape)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    out = np.zeros((n_rows, FEATURES), np.float32)
    half = FEATURES // 2
    if len(data) >= 3:
        gram = (shape[:-2] << np.uint32(16)) | (shape[1:-1] << np.uint32(8)) | shape[2:]
        ok = row[2:] == row[:-2]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - half.bit_length() + 1)
        out[:, :half] = np.bincount(row[:-2][ok] * half + bucket[ok], minlength=n_rows * half).reshape(n_rows, half)
    start, end, wrow = runs(data > 32, offsets)
    name = SpanHasher(shape.astype(np.uint8))(start, end)
    if len(name) > 1:
        ok = wrow[1:] == wrow[:-1]
        rest = FEATURES - half - 3
        bucket = np.where(name[1:] == name[:-1], 0, 1 + (name[1:] >> np.uint64(40)).astype(np.int64) % (rest - 1))
        out[:, half:half + rest] = np.bincount(wrow[1:][ok] * rest + bucket[ok], minlength=n_rows * rest).reshape(n_rows, rest)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    m = measures(offsets, data) if m is None else m
    out[:, -3], out[:, -2], out[:, -1] = m[:, 4], np.minimum(m[:, 7], 100) / 100, 1.0
    return out


def train_scorer(x: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Logistic regression on soft labels, by stochastic gradient steps scaled per weight."""
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    weight = np.minimum(weight, 5.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            pick = order[lo:lo + 64]
            z = x[pick] @ w
            g = x[pick].T @ ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick]) / len(pick) + 1e-5 * w
            seen += g * g
            w -= RATE * g / np.sqrt(seen)
    return w


class Model:
    def __init__(self, labels: LabelModel, weights: np.ndarray):
        self.labels, self.weights = labels, weights


def _with_votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [_codes(votes(measures(offsets, data))) for _, _, offsets, data in text_chunks(batch.column(1), CHUNK)]
            if code:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(code))], names=["doc_id", "code"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(look, "doc_id long, code long")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Label model from the votes of all texts, scorer from a bounded sample by hash of the id."""
    ship(docs.sparkSession)
    seen = materialize(_with_votes(docs, id_col, text_col), "quality-votes")
    counts = seen.groupBy("code").agg(F.count("*").alias("n")).toPandas().sort_values("code")
    if len(counts) == 0:
        return None
    labels = LabelModel(counts["code"].to_numpy(), counts["n"].to_numpy())
    known = seen.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"))
    n_ids = known.agg(F.approx_count_distinct("id")).first()[0]
    sample = sample_by_hash(known, "id", TRAIN_ROWS, n_ids)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rows = [], []
            for _, _, offsets, data in text_chunks(batch.column(1), CHUNK, CHUNK_ROWS):
                m = measures(offsets, data)
                codes += _codes(votes(m)).tolist()
                rows += [r.astype("<f4").tobytes() for r in features(offsets, data, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "code", "x"])

    found = sampled_texts(docs, sample, id_col, text_col).select("id", "text") \
        .mapInArrow(describe, "doc_id long, code long, x binary").toPandas().sort_values("doc_id")
    if len(found) == 0:
        return Model(labels, np.zeros(FEATURES))
    x = np.frombuffer(b"".join(found["x"]), "<f4").reshape(len(found), -1)
    return Model(labels, train_scorer(x, labels.posterior(_of_codes(found["code"].to_numpy()))))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, votes, posterior, score, keep`` of every row; ``votes`` has a sign per labeller."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in text_chunks(batch.column(1), CHUNK, CHUNK_ROWS):
                m = measures(offsets, data)
                v = votes(m)
                value = 1 / (1 + np.exp(-np.clip(features(offsets, data, m) @ model.weights, -50, 50)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(["".join("-0+"[x + 1] for x in r) for r in v.tolist()]),
                     pa.array(model.labels.posterior(v)), pa.array(value), pa.array(value >= KEEP)],
                    names=["doc_id", "votes", "posterior", "score", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep boolean")

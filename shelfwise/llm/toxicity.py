"""Toxicity scores from a convolutional text classifier.

Every word is the sum of hashed embeddings: one of the word itself and one of each of its
leading parts, so that unseen forms of a known stem are still close to it. Filters of
several widths run over the words of the whole text, each filter is max-pooled, and a
linear layer gives the logit. Everything is trained here, in numpy, on a bounded sample of
labelled rows. On a part of that sample that training never sees, a threshold is calibrated
for each language that the *text* itself suggests; the score is shifted so that each
language's threshold lies at ``DECISION``.

The model (about 2 MB, fixed by its parameters) is the only thing that travels to the
executors. Scoring is one pass over the texts without a shuffle.

Defined cases: a NULL or empty text, or one without words, has score 0. Repeated rows get equal scores. Only id and text are read; labels
whose ``toxic`` is NULL are not learned from, an id with both labels counts as toxic, and of several texts of an id
the least is learned from; without any usable label of both kinds every
score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.common import SpanHasher, fold_case, hash_place, mix64, runs, sample_by_hash, sampled_texts, text_chunks

DECISION = 0.7
#: Bounds of the labelled sample: rows of each label, and characters of a label's texts together (whole texts, of any length).
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 3000, 12_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Bytes of the leading parts that share an embedding.
STEMS = (4, 5, 6)
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Words that one pass of the filters handles.
BLOCK_WORDS = 16_384
SCORE_CHUNK = 1 << 18

# Frequent function words by which a text's language is guessed for calibration.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as at by this from are be or".split(),
    "de": "der die das und ist nicht ein eine mit von zu den im auf für sich dem auch es als".split(),
    "fr": "le la les de des du et un une est dans pour que qui sur par au avec pas en".split(),
    "es": "el la los las de del y un una es en que por con para se al como su lo".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return SpanHasher(data)(np.concatenate([[0], ends[:-1]]), ends)


@dataclass
class Words:
    """Hashed words of some texts: bucket numbers per word, first word of each text, language guess."""

    buckets: np.ndarray
    first: np.ndarray
    lang: np.ndarray


def hash_words(offsets: np.ndarray, data: np.ndarray, buckets: int = BUCKETS) -> Words:
    data = fold_case(data)
    is_word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    start, end, row = runs(is_word, offsets)
    n_rows = len(offsets) - 1
    spans = SpanHasher(data)
    whole = spans(start, end)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    parts = [whole >> shift]
    for k, size in enumerate(STEMS):
        parts.append(mix64(spans(start, np.minimum(end, start + size)) + np.uint64(k + 1)) >> shift)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    votes = np.zeros((n_rows, len(LANGS)), np.int64)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        hits = np.concatenate([[0], np.isin(whole, _word_hashes(words)).cumsum()])
        votes[:, k] = hits[first[1:]] - hits[first[:-1]]
    lang = np.where(votes.max(1) > 0, votes.argmax(1), len(LANGS) - 1)
    return Words(np.stack(parts, 1).astype(np.int32), first, lang)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[int, float] = field(default_factory=dict)

    @property
    def buckets(self) -> int:
        return len(self.embedding) - 1

    def _convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs per position; positions past the end see padding."""
        n = len(x)
        got = []
        flat = x @ np.concatenate([w for f in self.filters for w in f], axis=1)
        at = 0
        for f in self.filters:
            y = flat[:, at:at + f.shape[2]].copy()
            for j in range(1, len(f)):
                part = flat[:, at + j * f.shape[2]:at + (j + 1) * f.shape[2]]
                y[:n - j] += part[j:]
            at += len(f) * f.shape[2]
            got.append(y)
        return np.maximum(np.concatenate(got, axis=1) + self.bias, 0.0)

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        out = self.embedding[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            out += self.embedding[buckets[:, k]]
        return out

    def logits(self, words: Words) -> np.ndarray:
        n_rows = len(words.first) - 1
        lead = max(WIDTHS) - 1
        pooled = np.zeros((n_rows, len(self.bias)), np.float32)
        padded, starts = _pad(words, self.buckets)
        row_of = np.repeat(np.arange(n_rows), np.diff(starts))
        for a in range(0, len(row_of), BLOCK_WORDS):
            b = min(len(row_of), a + BLOCK_WORDS)
            y = self._convolve(self.embed(padded[a:b + lead]))[:b - a]
            rows = row_of[a:b]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
            top = np.maximum.reduceat(y, edge, axis=0)
            pooled[rows[edge]] = np.maximum(pooled[rows[edge]], top)
        # summed row by row: a matrix product may round a row differently by the number of rows beside it
        return (pooled * self.out).sum(axis=1) + self.out_bias

    def score(self, words: Words) -> np.ndarray:
        general = self.thresholds.get(-1, 0.0)
        limit = np.array([self.thresholds.get(k, general) for k in range(len(LANGS))])
        z = self.logits(words).astype(np.float64) - limit[words.lang] + np.log(DECISION / (1 - DECISION))
        return np.where(np.diff(words.first) > 0, 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))), 0.0)


def _pad(words: Words, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in turn, with padding before each text and at the end."""
    lead = max(WIDTHS) - 1
    n_rows = len(words.first) - 1
    starts = words.first + lead * np.arange(n_rows + 1)
    out = np.full((starts[-1] + 2 * lead, words.buckets.shape[1]), pad, np.int32)
    row = np.repeat(np.arange(n_rows), np.diff(words.first))
    out[np.arange(len(words.buckets)) + lead * (row + 1)] = words.buckets
    return out, starts


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list, rows: np.ndarray) -> None:
        """The first parameter is the embedding, of which only ``rows`` have a gradient."""
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, (p, g, m, v) in enumerate(zip(self.params, grads, self.m, self.v)):
            at = rows if k == 0 else slice(None)
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            p[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-8)


def train(texts: list[Words], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on texts (each a ``Words`` of one row), by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
    emb[-1] = 0.0
    filters = [(rng.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
    n_out = FILTERS * len(WIDTHS)
    bias, out, out_bias = (np.zeros(n_out, np.float32), (rng.standard_normal(n_out) / np.sqrt(n_out)).astype(np.float32),
                           np.zeros(1, np.float32))
    model = Model(emb, filters, bias, out, 0.0)
    adam = _Adam([emb, *filters, bias, out, out_bias], RATE)
    labels = np.asarray(labels, np.float32)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
    order = rng.permutation(len(texts))
    for epoch in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            sizes = [len(texts[i].buckets) for i in pick]
            words = Words(np.concatenate([texts[i].buckets for i in pick]), np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(pick)))
            padded, starts = _pad(words, BUCKETS)
            x = model.embed(padded)
            y = model._convolve(x)
            top = np.empty((len(pick), n_out), np.int64)
            for r in range(len(pick)):
                top[r] = y[starts[r]:starts[r + 1]].argmax(0) + starts[r]
            pooled = y[top, np.arange(n_out)]
            z = pooled @ out + out_bias[0]
            grad_z = (1 / (1 + np.exp(-z)) - labels[pick]) * weight[pick] / len(pick)
            grad_pool = grad_z[:, None] * out * (pooled > 0)
            grad_x: dict[str, list] = {"at": [], "g": []}
            grads_f = []
            for k, f in enumerate(filters):
                col = slice(k * FILTERS, (k + 1) * FILTERS)
                at, g = top[:, col], grad_pool[:, col]
                gf = np.empty_like(f)
                for j in range(len(f)):
                    gf[j] = np.einsum("rfd,rf->df", x[at + j], g)
                    grad_x["at"].append((at + j).ravel())
                    grad_x["g"].append((g[:, :, None] * f[j].T).reshape(-1, DIM))
                grads_f.append(gf)
            at, g = np.concatenate(grad_x["at"]), np.concatenate(grad_x["g"])
            ids = padded[at]
            flat, inverse = np.unique(ids.ravel(), return_inverse=True)
            ge = np.zeros((len(flat), DIM), np.float32)
            np.add.at(ge, inverse.reshape(-1), np.repeat(g, ids.shape[1], axis=0))
            ge[flat == BUCKETS] = 0.0
            adam.step([ge, *grads_f, grad_pool.sum(0), pooled.T @ grad_z, np.array([grad_z.sum()], np.float32)], flat)
    model.out_bias = float(out_bias[0])
    return model


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, least: int = 15) -> None:
    """Per language the logit that best parts the calibration rows (key -1: all together)."""
    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        cuts = np.concatenate([[z[0] - 1.0], (z[1:] + z[:-1]) / 2, [z[-1] + 1.0]])
        missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
        false = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum())
        cost = missed + 4.0 * false
        tied = np.flatnonzero(cost <= cost.min() + 1e-12)
        return float((cuts[tied[0]] + cuts[tied[-1]]) / 2)

    model.thresholds = {-1: best(logits, labels)}
    for k in range(len(LANGS)):
        here = langs == k
        if min((labels[here] == 1).sum(), (labels[here] == 0).sum()) >= least:
            model.thresholds[k] = best(logits[here], labels[here])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learn from the labelled rows that are not held out; None when a label is missing altogether."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if len(counts) < 2:
        return None
    sample = None
    for toxic, bound in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = sample_by_hash(usable.where(F.col("y") == toxic), "id", bound, counts[toxic]).withColumn("y", F.lit(toxic))
        sample = part if sample is None else sample.unionAll(part)
    sample = sample.groupBy("id").agg(F.max("y").alias("y"))
    # In the order of the hash, whatever the texts' lengths, until a label's characters are used up.
    so_far = Window.partitionBy("y").orderBy(hash_place("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    found = sampled_texts(docs, sample, id_col, text_col) \
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(so_far), F.lit(0))).where(F.col("before") < TRAIN_CHARS) \
        .select("id", "y", "text").toPandas().sort_values("id")
    y = found["y"].to_numpy(np.float64)
    if len(found) == 0 or y.min() == y.max():
        return None
    texts = []
    for _, _, offsets, data in text_chunks(pa.array(found["text"], pa.string()), 1):
        texts.append(hash_words(offsets, data))
    kept_back = np.arange(len(y)) % 5 == 0
    rest = np.flatnonzero(~kept_back)
    model = train([texts[i] for i in rest], y[rest])
    back = np.flatnonzero(kept_back)
    if len(np.unique(y[back])) < 2:
        back = np.arange(len(y))
    z = np.concatenate([model.logits(texts[i]) for i in back])
    calibrate(model, z, y[back], np.concatenate([texts[i].lang for i in back]))
    return model


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_column(model: Model | None):
    """A column function ``text -> score``; runs where the rows are."""
    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            scores = np.zeros(len(column))
            if model is not None:
                for first, last, offsets, data in text_chunks(column, SCORE_CHUNK):
                    scores[first:last] = model.score(hash_words(offsets, data, model.buckets))
            yield pa.array(scores)

    return toxicity


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), score_column(model)(F.col(text_col).cast("string")).alias("score")) \
        .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                (F.col("score") >= DECISION).cast("int").alias("predicted"))

"""Language identification in two steps: family first, then language within the family.

Features are hashed counts of byte n-grams and of whole words of the text, square-rooted
and scaled to length one. One linear support vector machine per family (against the rest)
picks the family; within a family, one-versus-one linear support vector machines vote
between the closely related languages, the sum of margins deciding ties. All machines are
trained here, in numpy, on a bounded sample of rows whose language is known.

Only the weights (their size is fixed by ``FEATURES`` and the number of languages) travel
to the executors; scoring is one pass without a shuffle.

Defined cases: a NULL text, or one without any letter, is ``und`` with score 0. Rows of
NULL language are not learned from; of several texts or languages of an id the least is. Without any learnable row every text is ``und``; with a
single language every text with a letter is that language. Repeated rows get equal results.
Only id, text and, for learning, language are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.common import SpanHasher, fold_case, hash_limit, hash_place, runs, sampled_texts, text_chunks

#: Bounds of the learning sample: rows of one language, and of all; languages, the most frequent ones.
ROWS_PER_LANGUAGE, ROWS_TOTAL, MAX_LANGUAGES = 800, 6000, 100
#: Sizes of the feature groups: single bytes, pairs, triples, words.
SIZES = (256, 2048, 4096, 4096)
FEATURES = sum(SIZES)
EPOCHS, REGULARISER = 12, 1e-4
#: Bytes and rows of text that one matrix of features is made of.
CHUNK, CHUNK_ROWS = 1 << 19, 200
UNDETERMINED = "und"

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn mr ne pa gu".split(),
    "semitic": "ar he am mt".split(),
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), lang)


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text."""
    n_rows = len(offsets) - 1
    data = fold_case(data)
    is_word = (data >= 128) | ((data >= 97) & (data <= 122))
    plain = np.where(is_word, data, np.uint8(32))
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    out = np.zeros((n_rows, FEATURES), np.float32)
    at = 0
    code = plain.astype(np.uint32)
    gram, ok = code, is_word
    for size, width in zip(SIZES[:3], (1, 2, 3)):
        if width > 1:
            if len(data) < width:
                at += size
                continue
            gram = (gram[:-1] << np.uint32(8)) | code[width - 1:]
            same = row[width - 1:] == row[:len(row) - width + 1]
            ok = same & (is_word[width - 1:] | is_word[:len(row) - width + 1])
        bucket = gram if width == 1 else (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - size.bit_length() + 1)
        key = row[:len(gram)][ok] * size + bucket[ok]
        out[:, at:at + size] = np.bincount(key, minlength=n_rows * size).reshape(n_rows, size)
        at += size
    start, end, word_row = runs(is_word, offsets)
    bucket = SpanHasher(data)(start, end) >> np.uint64(64 - SIZES[3].bit_length() + 1)
    key = word_row * SIZES[3] + bucket.astype(np.int64)
    out[:, at:] = np.bincount(key, minlength=n_rows * SIZES[3]).reshape(n_rows, SIZES[3])
    np.sqrt(out, out=out)
    at = 0
    for size in SIZES:
        part = out[:, at:at + size]
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9) * np.sqrt(len(SIZES))
        at += size
    return out


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    def any_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], mask.cumsum()])
        return total[offsets[1:]] > total[offsets[:-1]]

    found = any_in(((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)))
    for k in np.flatnonzero(~found & any_in(data >= 128)):
        found[k] = any(c.isalpha() for c in data[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> np.ndarray:
    """Linear support vector machine on sparse rows, by averaged stochastic subgradient steps; last weight: bias."""
    rng = np.random.default_rng(seed)
    w = np.zeros(FEATURES + 1)
    mean = np.zeros(FEATURES + 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    t, scale, seen = 0, 1.0, 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1.0 / (REGULARISER * (t + 10_000))
            scale *= 1.0 - rate * REGULARISER
            at, value = x[i]
            if y[i] * (scale * (w[at] @ value) + w[-1]) < 1.0:
                w[at] += rate * weight[i] * y[i] / scale * value
                w[-1] += 0.1 * rate * weight[i] * y[i]
        if epoch >= EPOCHS // 2:
            mean[:-1] += w[:-1] * scale
            mean[-1] += w[-1]
            seen += 1
    return mean / seen


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    family_weights: np.ndarray  # (families, FEATURES + 1)
    pair_weights: list[dict[tuple[int, int], np.ndarray]]  # per family, positive for the first of the pair

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if len(self.families) > 1:
            margin = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
            family = margin.argmax(1)
            top = np.sort(margin, axis=1)
            sure = _squash(top[:, -1] - top[:, -2])
        else:
            family, sure = np.zeros(n, np.int64), np.ones(n)
        lang = np.empty(n, object)
        for f, members in enumerate(self.members):
            here = np.flatnonzero(family == f)
            if len(here) == 0:
                continue
            votes = np.zeros((len(here), len(members)))
            lead = np.full((len(here), len(members)), np.inf)
            for (i, j), w in self.pair_weights[f].items():
                m = x[here] @ w[:-1] + w[-1]
                votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                lead[:, i] = np.minimum(lead[:, i], m)
                lead[:, j] = np.minimum(lead[:, j], -m)
            won = votes.argmax(1)
            lang[here] = np.array(members, object)[won]
            if len(members) > 1:
                sure[here] *= _squash(lead[np.arange(len(here)), won])
        return lang, sure


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(3.0 * margin, -50, 50)))


def train(x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    families = sorted({family_of(v) for v in names})
    members = [[v for v in names if family_of(v) == f] for f in families]
    lang = np.array(langs, object)
    family = np.array([family_of(v) for v in langs], object)
    weights = np.zeros((len(families), FEATURES + 1))
    if len(families) > 1:
        for k, f in enumerate(families):
            weights[k] = train_svm(x, np.where(family == f, 1.0, -1.0), k)
    pairs: list[dict[tuple[int, int], np.ndarray]] = []
    for own in members:
        machines = {}
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                pick = np.flatnonzero((lang == own[i]) | (lang == own[j]))
                machines[i, j] = train_svm([x[k] for k in pick], np.where(lang[pick] == own[i], 1.0, -1.0), 100 + i + j)
        pairs.append(machines)
    return Model(families, members, weights, pairs)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from rows of known language that are not held out: a bounded sample, by hash of the id."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("y")) \
        .where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = known.groupBy("y").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.col("n").desc(), "y").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    bound = min(ROWS_PER_LANGUAGE, max(1, ROWS_TOTAL // len(sizes)))
    # A threshold on the hash per language leaves about half as many again as are wanted, however many rows there are.
    limits = known.sparkSession.createDataFrame([(r["y"], hash_limit(bound, r["n"])) for r in sizes], "y string, below long")
    near = known.join(F.broadcast(limits), "y").where(hash_place("id") < F.col("below")).groupBy("id").agg(F.min("y").alias("y"))
    order = Window.partitionBy("y").orderBy(hash_place("id"), "id")
    sample = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= bound).select("id", "y")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for first, last, offsets, data in text_chunks(batch.column(2), CHUNK, CHUNK_ROWS):
                for row in features(offsets, data):
                    used = np.flatnonzero(row)
                    at.append(used.astype("<u2").tobytes())
                    value.append(row[used].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()),
                                              pa.array(value, pa.binary())], names=["id", "y", "at", "value"])

    found = sampled_texts(docs, sample, id_col, text_col).select("id", "y", "text") \
        .mapInArrow(sparse, "id long, y string, at binary, value binary").toPandas().sort_values("id")
    x = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64))
         for a, v in zip(found["at"], found["value"])]
    return train(x, found["y"].tolist())


def predict_column(model: Model | None):
    """A column function ``text -> struct(lang_pred, score)``."""
    @F.arrow_udf("lang_pred string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            langs, scores = np.full(len(column), UNDETERMINED, object), np.zeros(len(column))
            if model is not None:
                for first, last, offsets, data in text_chunks(column, CHUNK, CHUNK_ROWS):
                    with_letter = has_letter(offsets, data)
                    lang, sure = model.predict(features(offsets, data))
                    langs[first:last] = np.where(with_letter, lang, UNDETERMINED)
                    scores[first:last] = np.where(with_letter, sure, 0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["lang_pred", "score"])

    return language


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), predict_column(model)(F.col(text_col).cast("string")).alias("p")) \
        .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")

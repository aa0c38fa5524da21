"""Exact similarity join on word shingles, by token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of ``k``-word shingles is at
least ``PERCENT`` hundredths. Documents with equal sets are one class from the start, known by a digest
of the set, so exact copies never meet. The classes are joined in three indexes over one
global token order (the tokens' hashes). With ``p(l) = n - ceil(t n) + l``, the first ``p(l)``
tokens of two sets that link share at least ``l`` tokens.

0. *First tokens.* Classes of similar size that share one of their first ``LEADING`` tokens are compared with the smallest
   class of the token's list: ``LEADING`` rows a class at most. Most copies are in their components after this, and the indexes
   that follow make pairs only across components.
1. *All classes, extended prefixes, single tokens.* Every set indexes its prefix extended to
   ``l = 1 + n // 10``. A token that more than ``RARE`` classes index is frequent. Classes that share
   a rare token and are not connected yet become candidates. A set with fewer than ``1 + floor(0.075 n)`` frequent tokens in
   its prefix shares a rare one with each of its partners, so its candidates are complete.
2. *The other sets, all tokens, single tokens.* Frequencies are taken anew among these sets alone.
   A set with fewer frequent tokens than ``ceil(t n)`` is complete now.
3. *What is left: sets that consist of frequent tokens, such as members of large groups of near
   copies.* Their prefixes fall into classes of tokens by hash, and every combination of two
   tokens of one class is a key; by the pigeonhole principle two linked sets share a key.
   Holders of a key are compared with one pivot first. Holders of a key that are still in different components fall into one
   neighbourhood afterwards, and the sets of a neighbourhood are compared block by block, in matrices of shared tokens.

Candidates that cannot reach the threshold by their counts of shared rare tokens are pruned, each rule
being exact. Survivors are verified on the whole sets: first one partner of each class, then
only pairs that are not connected yet. A link inside a component changes nothing, so the
components are those of all links.

No step emits all pairs of a group of copies, and no token's list is held beyond ``RARE``
entries per task that indexes it: a task that sees more sends a mark instead. A bucket emits lists of holders, not their pairs;
equal lists of all buckets (a passage has one for each of its tokens) are made into pairs once. Tokens are
64-bit hashes of shingles; sets are compared by them.

Defined cases: NULL, empty and white-space-only texts have no shingles, link with nothing and are
their own component. A text of fewer than ``k`` words has its whole sequence as one shingle. Repeated
rows (equal id and text) give repeated result rows. Rows of NULL id link like others, and may join others' components, but a
NULL id is never a component's name: components without any other id have NULL. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import SpanHasher, components, give_back, materialize, mix64, runs, text_chunks

WORDS, PERCENT = 5, 75
#: First tokens by which classes meet before anything is indexed, and parts that a frequent one is dealt into.
LEADING, SALT = 4, 8
#: Longest list of a token whose holders are all compared.
RARE = 32
#: Postings that one task gathers before it sends them, and that one bucket is planned to hold.
FLUSH, BUCKET = 600_000, 600_000
#: Tokens of the sets of one block, and what a set counts besides its tokens; a block is compared with one other at a time.
BLOCK, SET_COST = 1_000_000, 256
#: Bytes of an Arrow batch: rows carry whole sets, and two workers stand beside an executor's heap.
BATCH = 2 << 20
_ORDER = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sets

def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in ascending order, and where each text's begin."""
    n_rows = len(offsets) - 1
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    start, end, row = runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    word = SpanHasher(data)(start, end)
    words = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], words.cumsum()])
    full = max(0, len(word) - k + 1)
    value = np.zeros(full, np.uint64)
    for j in range(k):
        value = value * _ORDER + word[j:full + j]
    inside = row[:full] == row[k - 1:] if full else np.zeros(0, bool)
    tokens, owner = [mix64(value[inside])], [row[:full][inside]]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words[short] > j
            value[has] = value[has] * _ORDER + word[first[short[has]] + j]
        tokens.append(mix64(value + words[short].astype(np.uint64)))
        owner.append(short)
    token, owner_ = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((token, owner_))
    token, owner_ = token[order], owner_[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner_[1:] != owner_[:-1])
    token, owner_ = token[fresh], owner_[fresh]
    return token, np.searchsorted(owner_, np.arange(n_rows + 1))


def digests(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (equal sets, equal names)."""
    size = np.diff(first)
    sums = np.concatenate([np.zeros(1, np.uint64), mix64(token + _ORDER).cumsum(dtype=np.uint64)])
    return mix64((sums[first[1:]] - sums[first[:-1]]) + size.astype(np.uint64)).view(np.int64)


def _least_overlap(n):
    return -(-PERCENT * n // 100)


def _overlap(na, nb):
    """Sets of these sizes link when they share at least this many tokens."""
    return PERCENT * (na + nb) / (100 + PERCENT)


def extension(n):
    return 1 + n // 10


# ---------------------------------------------------------------- index

_INDEX = "bucket int, token binary, class binary, size binary, heavy binary, times binary, member binary, component binary"
_FOUND = "kind int, a long, n long, holders binary"
_PAIRS = "a long, b long, na int, nb int, n long"
PAIR, HEAVY, STAR = 0, 1, 2


def _index_rows(token: np.ndarray, cls: np.ndarray, size: np.ndarray, component: np.ndarray, buckets: int, limit: int) -> pa.RecordBatch:
    """Postings by bucket. A token with over ``limit`` holders here sends one mark (negative size), its holders a count.
    Classes that are connected already send their component, once a bucket."""
    order = np.lexsort((cls, token))
    token, cls, size, component = token[order], cls[order], size[order], component[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, size, component = token[fresh], cls[fresh], size[fresh], component[fresh]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(token)))
    many = np.repeat(count > limit, count)
    heavy, times = np.unique(cls[many], return_counts=True)
    mark = edge[count > limit]
    size = size.copy()
    size[mark] = -size[mark]
    keep = ~many
    keep[mark] = True
    token, cls, size, component = token[keep], cls[keep], size[keep], component[keep]
    bucket = (token % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    token, cls, size, component, bucket = token[order], cls[order], size[order], component[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: tuple[list, ...] = ([], [], [], [], [], [], [], [])
    for b in np.flatnonzero(np.diff(cut)):
        at = slice(cut[b], cut[b + 1])
        member, one = np.unique(cls[at], return_index=True)
        group = component[at][one]
        joined = member != group
        for column, value in zip(rows, (int(b), token[at].tobytes(), cls[at].tobytes(), size[at].astype("<i4").tobytes(), b"", b"",
                                        member[joined].tobytes(), group[joined].tobytes())):
            column.append(value)
    if len(heavy):
        for column, value in zip(rows, (int(heavy[0] % buckets), b"", b"", b"", heavy.tobytes(), times.astype("<i8").tobytes(), b"", b"")):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32())] + [pa.array(c, pa.binary()) for c in rows[1:]],
                                      names=[c.split()[0] for c in _INDEX.split(", ")])


class _Gather:
    """Collects postings of a task and flushes them as index rows."""

    def __init__(self, buckets: int, limit: int):
        self.buckets, self.limit = buckets, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, token: np.ndarray, cls: np.ndarray, size: np.ndarray, component: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((token, cls, size, component))
        self.held += len(token)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            parts, self.parts = self.parts, []
            yield _index_rows(*(np.concatenate(c) for c in zip(*parts)), self.buckets, self.limit)
            give_back()
        self.parts, self.held = [], 0


def _lean(step):
    """The step over one bucket, after which the worker gives back what the bucket took."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        out = step(table)
        give_back()
        return out

    run.__name__ = step.__name__
    return run


def _concat(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _pairs_of_lists(cls: np.ndarray, size: np.ndarray, component: np.ndarray, edge: np.ndarray, count: np.ndarray,
                    times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs within each list (at most ``RARE`` long) that are not connected and whose sizes allow a link; ``times`` is how many
    tokens have the list."""
    for c in np.unique(count[count > 1]):
        i, j = np.triu_indices(int(c), 1)
        lists = np.flatnonzero(count == c)
        for lo in range(0, len(lists), max(1, 100_000 // len(i))):
            here = lists[lo:lo + max(1, 100_000 // len(i)), None]
            x, y = (edge[here] + i).ravel(), (edge[here] + j).ravel()
            ok = (component[x] != component[y]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
            yield cls[x[ok]], cls[y[ok]], size[x[ok]], size[y[ok]], np.repeat(times[here], len(i))[ok]


def _unique_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, na, nb, n = a[order], b[order], na[order], nb[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[edge], b[edge], na[edge], nb[edge], np.add.reduceat(n, edge)


def _component_of(cls: np.ndarray, member: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The component of each class; a class that is no known member is its own."""
    out = cls.copy()
    if len(member):
        member, at = np.unique(member, return_index=True)
        component = component[at]
        place = np.minimum(np.searchsorted(member, cls), len(member) - 1)
        known = member[place] == cls
        out[known] = component[place[known]]
    return out


def _found(kind: int, a: np.ndarray, n: np.ndarray, holders: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(n), pa.array(holders, pa.binary())],
                                      names=["kind", "a", "n", "holders"])


def _match(table: pa.Table) -> pa.Table:
    """One bucket: the holders of its rare tokens, equal lists once with the number of their tokens, and counts of frequent tokens."""
    token, cls = _concat(table, "token", np.uint64), _concat(table, "class", np.int64)
    size = _concat(table, "size", "<i4").astype(np.int64)
    heavy, times = [_concat(table, "heavy", np.int64)], [_concat(table, "times", "<i8")]
    out = []
    if len(token):
        order = np.lexsort((size, cls, token))  # a mark comes before the same class's posting
        token, cls, size = token[order], cls[order], size[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        marked = size < 0
        # a class that some task has posted openly counts once per token, whatever marks there are
        group = fresh.cumsum() - 1
        posted = np.zeros(int(group[-1]) + 1, bool)
        posted[group[~marked]] = True
        token, cls, size, marked = token[fresh], cls[fresh], np.abs(size[fresh]), marked[fresh]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(edge, len(token)))
        frequent = (count > RARE) | np.logical_or.reduceat(marked, edge)
        of_frequent = np.repeat(frequent, count)
        h = cls[of_frequent & posted]
        heavy.append(h)
        times.append(np.ones(len(h), np.int64))
        component = _component_of(cls, _concat(table, "member", np.int64), _concat(table, "component", np.int64))
        # a list whose holders are all connected needs no pairs
        open_ = ~frequent & (np.minimum.reduceat(component, edge) != np.maximum.reduceat(component, edge))
        inside = np.repeat(open_, count)
        rows = np.stack([cls[inside], size[inside], component[inside]], 1)
        stop = 24 * np.append(0, count[open_].cumsum())
        blob = rows.tobytes()
        same: dict[bytes, int] = {}
        for lo, hi in zip(stop[:-1].tolist(), stop[1:].tolist()):
            same[blob[lo:hi]] = same.get(blob[lo:hi], 0) + 1
        out.append(_found(PAIR, np.zeros(len(same), np.int64), np.fromiter(same.values(), np.int64, len(same)), list(same)))
    h, t = np.concatenate(heavy), np.concatenate(times)
    if len(h):
        name, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, weights=t).astype(np.int64)
        out.append(_found(HEAVY, name, total, [b""] * len(name)))
    return pa.Table.from_batches(out, pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("holders", pa.binary())]))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of lists of holders, a limited number at a time, with the number of tokens shared."""
    for batch in batches:
        blobs = batch.column(0).to_pylist()
        cls, size, component = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3).T
        count = np.array([len(b) // 24 for b in blobs], np.int64)
        for part in _pairs_of_lists(cls, size, component, count.cumsum() - count, count, batch.column(1).to_numpy()):
            if len(part[0]):
                a, b, na, nb, n = _unique_pairs(*part)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(n)],
                                                 names=["a", "b", "na", "nb", "n"])


def _rows_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are kept as bytes: all tokens, and where each set's begin."""
    parts = [np.frombuffer(b, np.uint64) for b in blobs.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _index_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """Postings of ``class, size, component, tokens``; ``size`` is that of the whole set."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(buckets, RARE)
        for batch in batches:
            cls, size, component = (batch.column(k).to_numpy() for k in range(3))
            for lo in range(0, len(cls), 4096):
                token, first = _rows_of(batch.column(3).slice(lo, 4096))
                times = np.diff(first)
                yield from gather.add(token, *(np.repeat(v[lo:lo + 4096], times) for v in (cls, size, component)))
        yield from gather.flush()

    return sets.select("class", "size", "component", "tokens").mapInArrow(index, _INDEX)


def _with_component(sets: DataFrame, cc: DataFrame) -> DataFrame:
    return sets.join(cc.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _first_tokens(prefixes: DataFrame) -> DataFrame:
    """``token, band, class``: the first tokens of each class and its band of sizes."""
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            token, first = _rows_of(pa.array([blob[:8 * LEADING] for blob in batch.column(2).to_pylist()], pa.binary()))
            times = np.diff(first)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(_band(size), times).astype(np.int32)),
                                              pa.array(np.repeat(cls, times))], names=["token", "band", "class"])

    return prefixes.select("class", "size", "tokens").mapInArrow(lead, "token long, band int, class long")


def _first_stars(prefixes: DataFrame) -> DataFrame:
    """Each class with the smallest class that has one of its first tokens and a similar size; a token that very many classes
    have is dealt over ``SALT`` tasks."""
    leads = materialize(_first_tokens(prefixes), "join-first")
    pivots = leads.groupBy("token", "band").agg(F.min("class").alias("b"), F.max("class").alias("c")).where("b <> c") \
        .select("token", "band", "b", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return leads.withColumn("salt", F.pmod("class", F.lit(SALT)).cast("int")).join(pivots, ["token", "band", "salt"]) \
        .where("class <> b").select(F.col("class").alias("a"), "b").distinct()


def _candidates(index: DataFrame, buckets: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs that can still link, and frequent tokens per class, of one index."""
    found = materialize(index.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lean(_match), _FOUND), f"join-found-{level}")
    heavy = materialize(found.where(F.col("kind") == HEAVY).groupBy("a").agg(F.sum("n").alias("f")), f"join-heavy-{level}")
    small = F.least("na", "nb")
    need = 1 + F.floor(small / 10) if level == 1 else F.ceil(_overlap(F.col("na"), F.col("nb")) - 1e-6)
    lists = found.where(F.col("kind") == PAIR).groupBy("holders").agg(F.sum("n").alias("n"))
    pairs = lists.mapInArrow(_pairs, _PAIRS).groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("n").alias("n")) \
        .join(heavy.select("a", F.col("f").alias("fa")), "a", "left") \
        .join(heavy.select(F.col("a").alias("b"), F.col("f").alias("fb")), "b", "left") \
        .where(F.col("n") >= need - F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))) \
        .select("a", "b")
    return pairs, heavy


# ---------------------------------------------------------------- combinations

_KEYS = "bucket int, key binary, class binary, size binary, frequent binary, component binary"


def _combinations(token: np.ndarray, classes: int) -> np.ndarray:
    """Keys of all pairs of tokens of one class; with no class, of the single tokens."""
    if classes < 1:
        return mix64(token + _ORDER)
    group = token % np.uint64(classes)
    order = np.lexsort((token, group))
    token, group = token[order], group[order]
    keys = []
    for gap in range(1, len(token)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        keys.append(mix64(token[:-gap][same] * _ORDER + token[gap:][same] + np.uint64(classes)))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def combination_keys(token: np.ndarray) -> np.ndarray:
    """Keys of one set: two sets that link have one in common."""
    n = len(token)
    lead = token[:n - _least_overlap(n) + extension(n)]
    most = extension(n) - 1
    if most < 2:  # the partner, down to three quarters as long, may extend by nothing
        return np.unique(np.concatenate([_combinations(lead, 0), _combinations(lead, 1)])) if most else _combinations(lead, 0)
    classes = 1 << (most.bit_length() - 1)
    return np.unique(np.concatenate([_combinations(lead, classes), _combinations(lead, classes // 2)]))


def _index_combinations(sets: DataFrame, buckets: int) -> DataFrame:
    """Postings of combination keys; ``sets`` holds class, number of frequent tokens, component, tokens."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, frequent, component = (batch.column(i).to_numpy() for i in range(3))
            keys, size, held, lo = [], [], 0, 0
            for k, blob in enumerate(batch.column(3)):
                token = np.frombuffer(blob.as_buffer(), np.uint64)
                keys.append(combination_keys(token))
                size.append(len(token))
                held += len(keys[-1])
                if held >= FLUSH or k + 1 == len(cls):
                    yield rows_of(keys, np.array(size, np.int64), cls[lo:k + 1], frequent[lo:k + 1], component[lo:k + 1])
                    keys, size, held, lo = [], [], 0, k + 1

    def rows_of(keys: list[np.ndarray], size: np.ndarray, cls: np.ndarray, frequent: np.ndarray, component: np.ndarray) -> pa.RecordBatch:
        length = [len(k) for k in keys]
        key = np.concatenate(keys)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        columns = [key[order], *(np.repeat(v, length)[order] for v in (cls, size, frequent, component))]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32))] + [pa.array([c[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()) for c in columns],
            names=["bucket", "key", "class", "size", "frequent", "component"])

    return sets.select("class", "f", "component", "tokens").mapInArrow(index, _KEYS)


def _holders(table: pa.Table) -> tuple[np.ndarray, ...]:
    key, cls = _concat(table, "key", np.uint64), _concat(table, "class", np.int64)
    size, frequent, component = (_concat(table, c, np.int64) for c in ("size", "frequent", "component"))
    order = np.lexsort((cls, component, key))
    return key[order], cls[order], size[order], frequent[order], component[order]


def _band(size: np.ndarray) -> np.ndarray:
    """Sets of one band are close enough in size to link."""
    return np.floor(np.log(size) / -np.log(PERCENT / 100 + 1e-9)).astype(np.int64)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _distinct(a: np.ndarray, b: np.ndarray) -> pa.Table:
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIR)


def _by_frequent(size_a, size_b, frequent_a, frequent_b):
    """Whether two sets can link by their frequent tokens alone."""
    return (100 + PERCENT) * np.minimum(frequent_a, frequent_b) >= PERCENT * (size_a + size_b)


def _star(table: pa.Table) -> pa.Table:
    """Every holder of a key with the pivot of its band, where they are not connected: a row per holder, not per pair.

    The pivot is the holder with the largest share of frequent tokens, which is nearest to what
    a group of near copies has in common.
    """
    key, cls, size, frequent, component = _holders(table)
    band = _band(size)
    order = np.lexsort((cls, -frequent / size, band, key))
    key, cls, size, frequent, component, band = (v[order] for v in (key, cls, size, frequent, component, band))
    edge = np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])])
    pivot = np.flatnonzero(edge)[edge.cumsum() - 1]
    apart = (component != component[pivot]) & _by_frequent(size, size[pivot], frequent, frequent[pivot])
    return _distinct(cls[apart], cls[pivot[apart]])


def _least_label(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after those of each ``x`` and its ``y`` have become one: the smallest of all that are joined."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _crossing(table: pa.Table) -> pa.Table:
    """Holders of keys whose holders are in different components, with one of what their keys connect: a row per holder, not per pair."""
    key, cls, _, _, component = _holders(table)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(key)))
    inside = np.repeat(component[edge] != component[edge + count - 1], count)
    name, number = np.unique(cls, return_inverse=True)
    label = _least_label(np.arange(len(name)), number[inside], number[np.repeat(edge, count)[inside]])
    other = label != np.arange(len(name))
    return _distinct(name[other], name[label[other]])


def _neighbourhoods(sets: DataFrame, touching: DataFrame) -> DataFrame:
    """``class, size, component, tokens`` of the sets that share keys across components, with the two blocks (``lo``, ``hi``) in which they
    are to be compared and their own (``part``). A large neighbourhood is cut into several blocks; small ones share one."""
    near = components(touching)
    members = near.select(F.col("node").alias("class"), "component").unionAll(near.select(F.col("component").alias("class"), "component")).distinct()
    placed = materialize(sets.select("class", "size").join(members.select("class", F.col("component").alias("near")), "class"), "join-near")
    weight = placed.groupBy("near").agg(F.sum(F.col("size") + SET_COST).alias("weight"))
    small = F.col("weight") <= BLOCK
    total = weight.where(small).agg(F.sum("weight")).first()[0] or 0
    shared = max(1, 2 * int(total) // BLOCK)
    weight = weight.withColumn("parts", F.ceil(F.col("weight") / BLOCK).cast("int")) \
        .select("near", "parts", small.alias("small"), F.when(small, F.pmod(F.xxhash64("near"), F.lit(shared))).otherwise(F.col("near")).alias("place"))
    dealt = placed.join(weight, "near").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.select("class", "small", "place", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")) \
        .select("class", "small", "place", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return sets.join(dealt, "class")


def _shared_tokens(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of tokens that the sets ``a`` share with the sets ``b``, ``rows`` of ``a`` at a time (first row, matrix).

    Tokens that many sets hold are multiplied as columns of ones, the others counted pair by pair.
    """
    (ta, fa), (tb, fb) = a, b
    ua, ub = np.unique(ta), np.unique(tb)
    name = np.intersect1d(ua, ub, assume_unique=True)
    na, nb = len(fa) - 1, len(fb) - 1

    def known(token, first):
        at = np.searchsorted(name, token)
        here = at < len(name)
        here[here] = name[at[here]] == token[here]
        row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        return at[here].astype(np.int32), row[here]

    (ia, ra), (ib, rb) = known(ta, fa), known(tb, fb)
    order = np.argsort(ib, kind="stable")
    ib, rb = ib[order], rb[order]
    held = np.bincount(ib, minlength=len(name))
    start = held.cumsum() - held
    many = np.bincount(ia, minlength=len(name)) * held * 256 > na * nb
    column = many.cumsum() - 1
    columns = int(many.sum())
    cut = np.searchsorted(ra, np.append(np.arange(0, na, rows), na))
    dense_b = np.flatnonzero(many[ib])
    column_b = column[ib[dense_b]]  # ascending
    for lo, begin, end in zip(range(0, na, rows), cut, cut[1:]):
        hi = min(na, lo + rows)
        here = many[ia[begin:end]]
        dense_a = begin + np.flatnonzero(here)
        column_a = column[ia[dense_a]]
        out = np.zeros((hi - lo, nb), np.int32)
        for at in range(0, columns, 1024):
            x, y = np.zeros((hi - lo, 1024), np.float32), np.zeros((nb, 1024), np.float32)
            mine = (column_a >= at) & (column_a < at + 1024)
            x[ra[dense_a[mine]] - lo, column_a[mine] - at] = 1
            mine = slice(*np.searchsorted(column_b, [at, at + 1024]))
            y[rb[dense_b[mine]], column_b[mine] - at] = 1
            out += (x @ y.T).astype(np.int32)
        few = begin + np.flatnonzero(~here)
        upto = held[ia[few]].cumsum()
        at = 0
        while at < len(few):
            done = upto[at - 1] if at else 0
            mine = few[at:max(at + 1, int(np.searchsorted(upto, done + 1_000_000, side="right")))]
            times = held[ia[mine]]
            place = np.repeat(start[ia[mine]] - (times.cumsum() - times), times) + np.arange(int(times.sum()))
            np.add.at(out.reshape(-1), np.repeat(ra[mine] - lo, times) * nb + rb[place], 1)
            at += len(mine)
        yield lo, out


def _across(table: pa.Table) -> pa.Table:
    """Two blocks of sets (or one with itself): the links between components, as one row at most per set."""
    cls, component = (table.column(c).to_numpy() for c in ("class", "component"))
    lo, part = table.column("lo").to_numpy(), table.column("part").to_numpy()
    token, first = _rows_of(table.column("tokens"))
    name, label = np.unique(component, return_inverse=True)
    number = np.argsort(label, kind="stable")
    label = number[np.searchsorted(label[number], label)]  # the first set of each component here
    one, two = np.flatnonzero(part == lo), np.flatnonzero(part != lo)
    if table.column("hi")[0].as_py() == lo[0]:
        two = one
    if len(one) == 0 or len(two) == 0 or len(name) < 2:
        return _distinct(cls[:0], cls[:0])
    size = np.diff(first)

    def of(rows):
        return np.concatenate([token[first[k]:first[k + 1]] for k in rows]), np.append(0, size[rows].cumsum())

    before = label
    for at, common in _shared_tokens(of(one), of(two), max(1, (1 << 20) // len(two))):
        x = one[at:at + len(common)]
        linked = 100 * common.astype(np.int64) >= PERCENT * (size[x][:, None] + size[two] - common)
        i, j = np.nonzero(linked & (label[x][:, None] != label[two]))
        label = _least_label(label, x[i], two[j])
    moved = np.flatnonzero(label != before)
    return _distinct(cls[moved], cls[label[moved]])


# ---------------------------------------------------------------- verification

def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                     for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.arrow_udf(_shared, "int")("ta", "tb"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _joined(pairs: DataFrame, cc: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    x, y = (cc.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in ("a", "b"))
    return pairs.join(x, "a", "left").join(y, "b", "left") \
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, size, tokens`` of the classes in ``wanted``, from the text of one row of each."""
    chosen = classes.join(wanted, "class", "left_semi").select(F.col("row.doc_id").alias("of"), F.col("row.text_hash").alias("of_text"), "class")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch.column(1)):
                token, first = shingle_sets(offsets, data)
                name = digests(token, first)
                mine = np.flatnonzero(name == batch.column(0).slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[mine]), pa.array(np.diff(first)[mine].astype(np.int64)),
                     pa.array([token[first[k]:first[k + 1]].tobytes() for k in mine], pa.binary())], names=["class", "size", "tokens"])

    # repeated rows come more than once
    rows = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")))
    sets = materialize(rows.select("class", "text").mapInArrow(tokens, "class long, size long, tokens binary"), "join-sets")
    if sets.count() != sets.select("class").distinct().count():
        sets = materialize(sets.dropDuplicates(["class"]), "join-sets-once")
    return sets


@contextmanager
def _arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Plans made meanwhile send Python batches of about this many bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct()


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    with _arrow_batches(docs.sparkSession, BATCH):
        return _shingle_components(docs, id_col, text_col)


def _shingle_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch.column(2)):
                token, first = shingle_sets(offsets, data)
                n, name = np.diff(first), digests(token, first)
                prefix: list[bytes | None] = [None] * len(n)
                for k in np.flatnonzero(n > 0):
                    if int(name[k]) not in seen:  # one row of a class in this task brings its extended prefix
                        seen.add(int(name[k]))
                        take = min(int(n[k]), int(n[k]) - int(_least_overlap(n[k])) + int(extension(n[k])))
                        prefix[k] = token[first[k]:first[k] + take].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(name, mask=n == 0),
                     pa.array(prefix, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "class", "tokens"])

    rows = materialize(docs.mapInArrow(describe, "doc_id long, text_hash long, n_shingles long, class long, tokens binary"), "join-rows")
    classes = materialize(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")), "join-classes")
    prefixes = rows.where(F.col("tokens").isNotNull()).select("class", F.col("n_shingles").alias("size"), "tokens")
    total = classes.agg(F.sum("size")).first()[0] or 0

    # 0: the first tokens of each class
    stars = materialize(_first_stars(prefixes), "join-stars")
    sets = _whole_sets(docs, classes, _ends(stars))
    cc = components(materialize(_verified(stars, sets), "join-links-0"))

    # 1: all classes, extended prefixes, across components
    buckets = max(1, int(total * 0.35) // BUCKET)
    pairs, heavy = _candidates(_index_sets(_with_component(prefixes, cc), buckets), buckets, 1)
    pairs = materialize(pairs, "join-pairs-1")
    still = classes.join(heavy.select(F.col("a").alias("class"), "f"), "class") \
        .where(F.col("f") >= 1 + F.floor(F.col("size") * 75 / 1000))
    still = materialize(still.select("class", "size"), "join-still-1")
    wanted = _ends(pairs).unionAll(still.select("class")).distinct().join(sets.select("class"), "class", "left_anti")
    sets = sets.unionAll(_whole_sets(docs, classes, wanted))

    # 2: the classes with many frequent tokens, all tokens
    total = still.agg(F.sum("size")).first()[0] or 0
    left = None
    if total:
        buckets = max(1, int(total) // BUCKET)
        own = sets.join(still.select("class"), "class", "left_semi")
        more, heavy = _candidates(_index_sets(_with_component(own, cc), buckets), buckets, 2)
        pairs = materialize(pairs.unionAll(more).distinct(), "join-pairs-2")
        left = materialize(still.join(heavy.select(F.col("a").alias("class"), "f"), "class")
                           .where(F.col("f") >= F.ceil(F.col("size") * PERCENT / 100)).select("class", "size", "f"), "join-still-2")

    def settle(new: DataFrame) -> None:
        """Take in what links."""
        nonlocal cc
        if not new.isEmpty():  # what is known already is one edge a member
            cc = components(cc.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(new))

    def verify(found: DataFrame, label: str) -> None:
        """Verify pairs across components."""
        settle(materialize(_verified(_joined(found, cc).distinct(), sets), label))

    # verification: one partner of each class, and the pivots, then what is not connected yet
    chosen = pairs.groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("b"))
    total = left.agg(F.sum("size")).first()[0] if left is not None else 0
    if total:
        buckets = max(1, int(total) // (BUCKET // 4))
        own = sets.join(left.select("class", "f"), "class")
        keyed = _index_combinations(_with_component(own, cc), buckets)
        chosen = chosen.unionAll(keyed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lean(_star), "a long, b long"))
    verify(chosen, "join-links-1")
    verify(pairs, "join-links-2")
    if total:
        own = _with_component(own, cc)
        keyed = _index_combinations(own, buckets)
        touching = materialize(keyed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lean(_crossing), "a long, b long"), "join-crossing")
        if not touching.isEmpty():
            blocks = _neighbourhoods(own, touching).select("class", "component", "tokens", "small", "place", "lo", "hi", "part")
            settle(materialize(blocks.groupBy("small", "place", "lo", "hi").applyInArrow(_lean(_across), "a long, b long"), "join-links-3"))

    named = _with_component(classes.select("class", "doc_id"), cc)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "component").select("class", "component_id")
    return rows.select("doc_id", "n_shingles", "class").join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

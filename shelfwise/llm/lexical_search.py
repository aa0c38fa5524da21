"""Ranked lexical search: the best documents of a corpus for each of many query texts, exactly.

A document's score for a query sums, over the query's distinct terms, weight times impact in whole numbers (see
``weights`` and ``impacts``). The index blocks every term's posting list geometrically:

1. *Forward rows.* One pass finds each document's number of terms and its occurrences of the terms that queries
   hold; the corpus counts (documents, terms, documents per term) come from these rows.
2. *Clusters.* A bounded sample of documents are the centroids; every document joins the centroid whose weighted terms
   are nearest to its own strongest ones, and clusters lie side by side in a range partitioning, split as finely as
   rows need it, so a cluster of very many documents (copies, say) fills many partitions.
3. *Pieces.* A piece is up to ``PIECE`` neighbours of a cluster. It cuts the list of each of its terms into one block, with the
   documents' impacts and the block's summary: the largest impact that any document of the block has for every
   term that some query asks for together with the block's term.
4. *Search.* A task goes through its pieces with the ``top`` best of each query so far. A block is skipped only
   when the weighted sum of its summary over the query's terms, which no document of the block exceeds, is
   below the score that the query's last place holds; documents of the others are scored exactly. A document that belongs
   in the result is in the block of each of its terms, and none of these can be skipped. What tasks find is ranked together.

No list, cluster or set of scores is ever in one place: a task holds one piece, and ``top`` rows a query leave it. Queries are
handled in blocks of bounded rows and characters, which are all that passes through the driver.

Defined cases: NULL, empty and termless texts count nowhere and are never found; a query without terms has no result
rows. Repeated documents are ranked each, also under one id; a NULL id comes last among equal scores. Repeated
queries are answered each. Terms are told apart by a 64-bit hash and their length. Other columns are ignored.
Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import SpanHasher, materialize, runs, sample_by_hash, text_chunks

TOP = 50
#: Documents and distinct terms of a piece at most (a single document may have more terms).
PIECE, PIECE_TERMS = 512, 4096
#: Centroids at most, and the strongest terms by which documents are compared with them.
CENTROIDS, LEAD = 256, 16
#: Queries and characters of queries that one pass over the corpus answers.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 1 << 25
#: Rows that one index partition is planned for.
PARTITION_ROWS = 8192
_FORWARD = "doc_id long, n long, terms binary, tf binary"
_SORTED = "cluster int, lead int, doc_id long, terms binary, impact binary"
_PIECES = "ids binary, no_id binary, first binary, terms binary, impact binary, block binary, coordinate binary, summary binary"
_HITS = "q int, doc_id long, score long"


# ---------------------------------------------------------------- terms and weights

def spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and row of every term of a chunk of texts: maximal matches of letters, digits and non-ASCII."""
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    inside = (lower >= 0x80) | ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57))
    start, end, row = runs(inside, offsets)
    return SpanHasher(lower)(start, end), end - start, row


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Queries:
    """The terms of a block of queries, numbered in order of hash."""

    def __init__(self, texts: list[str | None]):
        per = []
        for text in texts:
            data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            h, length, _ = spans(np.array([0, len(data)]), data)
            per.append(np.unique(np.stack([h, length.astype(np.uint64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64))
        every = np.concatenate([*per, np.zeros((0, 2), np.uint64)])
        pairs, inverse = np.unique(every, axis=0, return_inverse=True)
        self.hash, self.length = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in per])]).astype(np.int64)
        self.term = inverse.reshape(-1).astype(np.int64)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, q: int) -> np.ndarray:
        return self.term[self.first[q]:self.first[q + 1]]

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where no query holds it. Equal hashes of different lengths stand side by side."""
        found = np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.hash, h)
        for _ in range(2):
            ok = at < len(self.hash)
            hit = ok.copy()
            hit[ok] = (self.hash[at[ok]] == h[ok]) & (self.length[at[ok]] == length[ok])
            found[hit & (found < 0)] = at[hit & (found < 0)]
            at = at + 1
        return found


# ---------------------------------------------------------------- forward rows

def forward_rows(docs: DataFrame, queries: Queries) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch.column(1)):
                h, length, row = spans(offsets, data)
                n = np.bincount(row, minlength=hi - lo)
                term = queries.find(h, length)
                mine = term >= 0
                size = max(1, len(queries.hash))
                key, tf = np.unique(row[mine] * size + term[mine], return_counts=True)
                first = np.searchsorted(key, np.arange(hi - lo + 1) * size)
                terms, tf = (key % size).astype("<i4"), tf.astype("<i4")
                keep = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(keep)), pa.array(n[keep].astype(np.int64)),
                     pa.array([terms[first[k]:first[k + 1]].tobytes() for k in keep], pa.binary()),
                     pa.array([tf[first[k]:first[k + 1]].tobytes() for k in keep], pa.binary())], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(rows, _FORWARD)


def _document_counts(forward: DataFrame, n_terms: int) -> np.ndarray:
    """Documents per query term, summed up in the tasks first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_ints(batch.column(0)), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for term, n in forward.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def _ints(blobs: pa.Array, dtype="<i4") -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype).astype(np.int64)


def _firsts(blobs: pa.Array, width: int = 4) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(b) // width for b in blobs.to_pylist()])]).astype(np.int64)


# ---------------------------------------------------------------- clusters and pieces

def _strongest(first: np.ndarray, terms: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of largest value of every row, as a matrix filled up with value 0."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((terms, -value, row))
    place = np.arange(len(row)) - first[row]
    front = place < most
    idx, val = np.zeros((n, most), np.int64), np.zeros((n, most), np.float32)
    idx[row[front], place[front]] = terms[order][front]
    val[row[front], place[front]] = value[order][front]
    return idx, val


def _centroids(forward: DataFrame, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Unit vectors of a bounded sample of documents, as columns."""
    keyed = forward.where(F.length("terms") > 0).withColumn("key", F.xxhash64("doc_id", "terms", "tf"))
    most = min(CENTROIDS, max(1, n_docs // PIECE))
    sample = sample_by_hash(keyed, "key", most, n_docs)  # keys alone; repeated rows are merged before and after
    rows = keyed.join(F.broadcast(sample), "key").groupBy("key").agg(F.min(F.struct("n", "terms", "tf")).alias("row"))
    lead = rows.orderBy("key").select("row.*").toArrow()
    out = np.zeros((len(w), max(1, len(lead))), np.float32)
    for k, (n, terms, tf) in enumerate(zip(*(lead.column(c).to_pylist() for c in ("n", "terms", "tf")))):
        term, tf = np.frombuffer(terms, "<i4"), np.frombuffer(tf, "<i4").astype(np.int64)
        value = (w[term] * impacts(tf, np.full(len(tf), n, np.int64), n_docs, n_terms)).astype(np.float32)
        top = np.argsort(-value, kind="stable")[:2 * LEAD]
        out[term[top], k] = value[top] / max(1e-9, float(np.sqrt((value[top] ** 2).sum())))
    return out


def _clustered(forward: DataFrame, w: np.ndarray, centroids: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                first, terms, tf = _firsts(part.column(2)), _ints(part.column(2)), _ints(part.column(3))
                n = np.repeat(part.column(1).to_numpy(), np.diff(first))
                impact = impacts(tf, n, n_docs, n_terms)
                idx, val = _strongest(first, terms, (w[terms] * impact).astype(np.float32), LEAD)
                near = np.zeros((len(idx), centroids.shape[1]), np.float32)
                for j in range(LEAD):
                    near += val[:, j:j + 1] * centroids[idx[:, j]]
                flat = impact.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.argmax(1).astype(np.int32)), pa.array(idx[:, 0].astype(np.int32)), part.column(0), part.column(2),
                     pa.array([flat[first[k]:first[k + 1]].tobytes() for k in range(len(first) - 1)], pa.binary())],
                    names=["cluster", "lead", "doc_id", "terms", "impact"])

    return forward.where(F.length("terms") > 0).mapInArrow(assign, _SORTED)


def _together(queries: Queries, local: np.ndarray) -> np.ndarray:
    """Which pairs of a piece's terms some query holds both of."""
    place = np.full(len(queries.hash), -1, np.int64)
    place[local] = np.arange(len(local))
    both = np.zeros((len(local), len(local)), bool)
    for q in range(len(queries)):
        at = place[queries.of(q)]
        at = at[at >= 0]
        both[np.ix_(at, at)] = True
    return both


def _summaries(first: np.ndarray, place: np.ndarray, impact: np.ndarray, n_local: int) -> np.ndarray:
    """Row t: the largest impact, for every term, of the documents that hold term t."""
    out = np.zeros((n_local, n_local), np.int32)
    for k in range(len(first) - 1):
        at, value = place[first[k]:first[k + 1]], impact[first[k]:first[k + 1]]
        cell = np.ix_(at, at)
        out[cell] = np.maximum(out[cell], value.astype(np.int32))
    return out


def _piece_row(ids: list, terms: list[np.ndarray], impact: list[np.ndarray], queries: Queries) -> list[bytes]:
    first = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    term, value = np.concatenate(terms).astype(np.int64), np.concatenate(impact).astype(np.int64)
    block = coordinate = summary = np.zeros(0, np.int32)
    if len(ids) > 1:
        local, place = np.unique(term, return_inverse=True)
        most = _summaries(first, place, value, len(local))
        most[~_together(queries, local)] = 0
        b, c = np.nonzero(most)
        block, coordinate, summary = b.astype("<i4"), c.astype("<i4"), most[b, c].astype("<i4")
    return [np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
            first.astype("<i4").tobytes(), term.astype("<i4").tobytes(), value.astype("<i4").tobytes(),
            block.tobytes(), coordinate.tobytes(), summary.tobytes()]


def _pieces(clustered: DataFrame, queries: Queries, partitions: int) -> DataFrame:
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        terms: list[np.ndarray] = []
        impact: list[np.ndarray] = []
        seen, distinct, of = np.zeros(len(queries.hash), bool), 0, None

        def row() -> pa.RecordBatch:
            values = _piece_row(ids, terms, impact, queries)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=names)

        for batch in batches:
            for cluster, doc_id, t, i in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4))):
                t, i = np.frombuffer(t, "<i4"), np.frombuffer(i, "<i4")
                fresh = int((~seen[t]).sum())
                if ids and (cluster != of or len(ids) >= PIECE or distinct + fresh > PIECE_TERMS):
                    yield row()
                    ids, terms, impact = [], [], []
                    seen[:] = False
                    distinct, fresh = 0, len(t)
                of = cluster
                seen[t] = True
                distinct += fresh
                ids.append(doc_id)
                terms.append(t)
                impact.append(i)
        if ids:
            yield row()

    ordered = clustered.repartitionByRange(partitions, "cluster", "lead", "doc_id").sortWithinPartitions("cluster", "lead", "doc_id")
    return ordered.mapInArrow(cut, _PIECES)


# ---------------------------------------------------------------- search

class _Best:
    """The best rows of each query so far, and the score from which a further one matters."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n)]
        self.least = np.ones(n, np.int64)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(c) for c in zip(self.rows[q], (score, ids, no_id)))
        order = np.lexsort((ids, no_id, -score))[:self.top]
        self.rows[q] = score[order], ids[order], no_id[order]
        if len(order) == self.top:
            self.least[q] = max(1, score[order[-1]])


def _search_piece(queries: Queries, w: np.ndarray, best: _Best, values: list[bytes], work: dict) -> None:
    ids, no_id = np.frombuffer(values[0], "<i8"), np.frombuffer(values[1], np.uint8).astype(bool)
    first, term, impact, block, coordinate, summary = (np.frombuffer(v, "<i4").astype(np.int64) for v in values[2:])
    local, at = np.unique(term, return_inverse=True)
    scores = np.zeros((len(ids), len(local)), np.int64)
    scores[np.repeat(np.arange(len(ids)), np.diff(first)), at] = impact
    bounds = np.zeros((len(local), len(local)), np.int64)
    bounds[block, coordinate] = summary
    place = np.full(len(w), -1, np.int64)
    place[local] = np.arange(len(local))
    # no document of the piece exceeds the sum of the piece's largest impacts
    whole = np.zeros(len(w), np.int64)
    whole[local] = scores.max(0) * w[local]
    sums = np.concatenate([[0], whole[queries.term].cumsum()])
    reach = sums[queries.first[1:]] - sums[queries.first[:-1]]
    for q in np.flatnonzero(reach >= best.least):
        mine = place[queries.of(q)]
        mine = mine[mine >= 0]
        weight = w[local[mine]]
        if len(ids) == 1:
            docs = np.zeros(1, np.int64)
        else:
            open_ = mine[bounds[np.ix_(mine, mine)] @ weight >= best.least[q]]
            work["skipped"] += len(mine) - len(open_)
            work["opened"] += len(open_)
            docs = np.flatnonzero((scores[:, open_] > 0).any(1))
        if len(docs):
            score = scores[np.ix_(docs, mine)] @ weight
            good = score >= best.least[q]
            if good.any():
                best.add(q, score[good], ids[docs[good]], no_id[docs[good]])


def _hits(pieces: DataFrame, queries: Queries, w: np.ndarray, top: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, work = _Best(len(queries), top), {"skipped": 0, "opened": 0}
        for batch in batches:
            for k in range(batch.num_rows):
                _search_piece(queries, w, best, [batch.column(c)[k].as_py() for c in range(8)], work)
        for q, (score, ids, no_id) in enumerate(best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), q, np.int32)), pa.array(ids, mask=no_id), pa.array(score)], names=["q", "doc_id", "score"])

    return pieces.mapInArrow(search, _HITS)


def _answer(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``q, rank, doc_id, score`` for one block of queries."""
    forward = materialize(forward_rows(docs, queries), "search-forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = weights(n_docs, _document_counts(forward, len(queries.hash)))
    clustered = _clustered(forward, w, _centroids(forward, w, n_docs, n_terms), n_docs, n_terms)
    pieces = materialize(_pieces(clustered, queries, 1 + n_docs // PARTITION_ROWS), "search-pieces")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return _hits(pieces, queries, w, top).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = 1 + max((n - 1) // BLOCK_ITEMS, chars // BLOCK_CHARS)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        queries = Queries([r["text"] for r in rows])
        if not len(queries.hash):
            continue
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "q int, item_id long")
        found = found.unionAll(_answer(docs, queries, top).join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return found

"""Document fingerprints from content-defined chunks.

A rolling gear hash over the text's bytes sets chunk boundaries, so an insertion moves only the
boundaries near it. Chunking is normalised: up to the usual chunk length a boundary needs more
zero bits of the hash than after it, and chunks are kept between ``MIN`` and ``MAX`` bytes. The
fingerprint is the set of the chunks' digests with their lengths; likeness of two fingerprints
is the length-weighted containment of the smaller set in the other.

Texts move once, by ranges of the id: the successor of each document is found in the sorted range,
and only the first document of a range is sent to the range before it as well. The driver holds the
range borders (one number per range) and nothing of the texts.

Defined cases: a NULL text is empty. The empty text's fingerprint is the empty string; two empty
fingerprints are alike (1), an empty and another one are not (0). Rows are ordered by id, then text,
NULL ids first; repeated rows follow one another. In a table of one row the row is its own
successor. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import mix64, ship

#: Bytes of a chunk: least, usual, most.
MIN, USUAL, MAX = 8, 24, 96
#: Zero bits that a boundary needs before and after the usual length.
STRICT_BITS, LOOSE_BITS = 6, 3
#: Rows that one range of ids is planned to hold.
RANGE_ROWS = 5_000
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_NOTHING = -(1 << 63)


def boundaries(data: np.ndarray) -> np.ndarray:
    """End positions of the chunks of one text; the last is the text's length."""
    n = len(data)
    if n <= MIN:
        return np.array([n] if n else [], np.int64)
    # gear hash h = 2 h + G[byte] over the last 32 bytes, by doubling the window
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if n > width:
            h[width:] += h[:-width] << np.uint32(width)
    top = h >> np.uint32(32 - STRICT_BITS)
    loose = np.flatnonzero(top < (1 << (STRICT_BITS - LOOSE_BITS))) + 1
    strict = (np.flatnonzero(top == 0) + 1).tolist()
    loose = loose.tolist()
    out: list[int] = []
    start = i = j = 0
    n_strict, n_loose = len(strict), len(loose)
    while n - start > MIN:
        low, usual, high = start + MIN, start + USUAL, start + MAX
        while i < n_strict and strict[i] < low:
            i += 1
        if i < n_strict and strict[i] <= usual:
            cut = strict[i]
        else:
            while j < n_loose and loose[j] <= usual:
                j += 1
            cut = loose[j] if j < n_loose and loose[j] <= high else high
        if cut >= n:
            break
        out.append(cut)
        start = cut
    out.append(n)
    return np.array(out, np.int64)


class Fingerprint:
    """Digests (40 bits) and lengths of the distinct chunks, in ascending order of digest."""

    __slots__ = ("digest", "length")

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        end = boundaries(raw)
        if len(end) == 0:
            self.digest = self.length = np.zeros(0, np.uint64)
            return
        start = np.concatenate([[0], end[:-1]])
        size = end - start
        # all chunks hashed at once: byte values by place in the chunk, mixed and summed up
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)
        value = mix64(raw.astype(np.uint64) + (place << np.uint64(8)) + np.uint64(0xA5A5_0000_0000))
        digest = mix64(np.add.reduceat(value, start) + size.astype(np.uint64)) >> np.uint64(24)
        self.digest, at = np.unique(digest, return_index=True)
        self.length = size[at].astype(np.uint64)

    def text(self) -> str:
        """Ten hexadecimal digits of digest and three of length per chunk."""
        packed = (self.digest << np.uint64(12)) | self.length
        raw = packed.astype(">u8").tobytes().hex()
        return "".join([raw[k + 3:k + 16] for k in range(0, len(raw), 16)])

    def likeness(self, other: "Fingerprint") -> float:
        if len(self.digest) == 0 or len(other.digest) == 0:
            return float(len(self.digest) == len(other.digest))
        _, at, _ = np.intersect1d(self.digest, other.digest, assume_unique=True, return_indices=True)
        return float(self.length[at].sum()) / float(min(self.length.sum(), other.length.sum()))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _borders(ids: DataFrame, rows: int) -> tuple[np.ndarray, dict[int, int], dict[int, int]]:
    """Range borders; for each range in use its first id, and the range before it (in a circle)."""
    n = max(1, -(-rows // RANGE_ROWS))
    shares = [k / n for k in range(1, n)]
    cuts = ids.agg(F.percentile_approx("k", shares, 100_000)).first()[0] if shares else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    first = ids.groupBy(_range_column(cuts)(F.col("k")).alias("g")).agg(F.min("k").alias("first")).collect()
    used = sorted(r["g"] for r in first)
    return cuts, {r["g"]: r["first"] for r in first}, {g: used[k - 1] for k, g in enumerate(used)}


def _range_column(cuts: np.ndarray):
    @F.arrow_udf("int")
    def range_of(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, k.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return range_of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, as in ``_RESULT``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(_NOTHING)))
    ids = keyed.select("k")
    cuts, first, before = _borders(ids, ids.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its range; the first of a range also, as a helper, to the range before."""
        starts = np.full(len(cuts) + 1, _NOTHING, np.int64)
        back = np.zeros(len(cuts) + 1, np.int32)
        for g in first:
            starts[g], back[g] = first[g], before[g]
        for batch in batches:
            k = batch.column(0).to_numpy()
            g = np.searchsorted(cuts, k, side="right").astype(np.int32)
            for rows, group, helper in ((None, g, False), (np.flatnonzero(k == starts[g]), None, True)):
                part = batch if rows is None else batch.take(pa.array(rows))
                group = back[g[rows]] if helper else group
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(np.full(part.num_rows, helper)), *part.columns], names=["g", "helper", "k", "doc_id", "text"])

    dealt = keyed.select("k", "doc_id", "text").mapInArrow(deal, "g int, helper boolean, k long, doc_id long, text string")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))

        out, size = [], 0
        waiting = None
        for g, helper, _, doc_id, text in rows():
            if waiting is not None and waiting[0] == g:
                own = Fingerprint(text.encode())
                out.append(_result(*waiting[1:], text, own))
                size += len(waiting[2])
            else:
                own = Fingerprint(text.encode())
            # after its helper a range is done; further helpers are repeated rows of the same id
            waiting = None if helper else (g, doc_id, text, own)
            if size >= 1 << 20:
                yield _table(out)
                out, size = [], 0
        if out:
            yield _table(out)

    n = len(cuts) + 1
    return dealt.repartition(n, "g").sortWithinPartitions("g", "helper", "k", "text") \
        .select("g", "helper", "k", "doc_id", "text").mapInArrow(follow, _RESULT)


def _result(doc_id, text: str, own: Fingerprint, following: str, next_print: Fingerprint) -> tuple:
    changed = edited(text, following).encode()
    other = Fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), own.text(), other.text(),
            own.likeness(other), own.likeness(next_print))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

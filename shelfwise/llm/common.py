"""Helpers shared by the operators: reading, shared scratch tables, Arrow text buffers,
vectorised hashing, and connected components.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import shelfwise
from shelfwise.session import scratch_path

#: Bytes of text that one vectorised step handles at a time, inside an Arrow batch.
CHUNK_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POLY = np.uint64(0x9E3779B97F4A7C15)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package: Spark serves a zip of its sources, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(shelfwise.__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="shelfwise-")) / "shelfwise.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def hash_place(key: str):
    """A fixed place of a key in [0, 2**30), in which samples are drawn."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30))


def hash_limit(bound: int, n: int) -> int:
    """Places below this hold about half as many again as ``bound`` of ``n`` distinct keys."""
    return int(min(1.0, 1.5 * bound / max(1, n) + 1e-6) * (1 << 30)) + 1


def sample_by_hash(rows: DataFrame, key: str, bound: int, n: int) -> DataFrame:
    """At most ``bound`` of about ``n`` distinct keys, those of the smallest hashes, one row each: a threshold on the hash leaves
    about half as many again to be sorted, however many rows and tasks there are and however often a key repeats."""
    near = rows.select(key).where(hash_place(key) < hash_limit(bound, n)).distinct()
    return near.orderBy(hash_place(key), key).limit(bound)


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One text (the least, of several) per id of a bounded sample, with the sample's other columns.

    The sample is broadcast, so no text is shuffled but those found; repetitions of an id are merged before and after.
    """
    other = [c for c in sample.columns if c != "id"]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .where(F.col("text").isNotNull()).join(F.broadcast(sample), "id").groupBy("id", *other).agg(F.min("text").alias("text"))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column as ``(first row, end row, offsets, UTF-8 bytes)``.

    Rows are never cut; a chunk holds at least one row. NULL reads as the empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64 if large else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        end = min(n, start + max_rows, max(end, start + 1))
        yield start, end, offsets[start:end + 1] - offsets[start], data[offsets[start]:offsets[end]]
        start = end
    give_back()


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


#: A fixed random value per byte, so that span hashes do not follow the byte's own bits.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _POLY)


class SpanHasher:
    """64-bit hashes of any spans of one byte buffer, all at once.

    A polynomial over the bytes is summed up once; the hash of a span is a difference of
    two sums, moved to the origin by the inverse power of the span's start.
    """

    _inverse = np.uint64(pow(int(_POLY), -1, 1 << 64))
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        cls = SpanHasher
        if len(cls._powers) < n + 1:
            size = (n >> 16 << 16) + (1 << 17)
            cls._powers = np.concatenate([np.ones(1, np.uint64), np.full(size, _POLY)]).cumprod(dtype=np.uint64)
            cls._inverses = np.concatenate([np.ones(1, np.uint64), np.full(size, cls._inverse)]).cumprod(dtype=np.uint64)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * cls._powers[:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * SpanHasher._inverses[start]
        return mix64(raw + (end - start).astype(np.uint64) * _MIX1)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross row borders: starts, ends, row numbers."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < n]
    first[borders] = mask[borders]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | first[1:]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 letters of UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 32
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows ``(node, component)``.

    ``component`` is the smallest node reachable. Alternating large-star and small-star
    steps; every step pre-aggregates minima per node, so a node with very many links
    costs one row per task, and each round's edges are written to the shared folder.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-edges")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(
            cur.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, link to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = materialize(small, "cc-round")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))

"""Lines that many documents share, dropped but for one holder; the index is a set of levelled sorted runs.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends and with A-Z in lower case. Keys of at least
``MIN_CHARS`` code points that at least ``MIN_DOCS`` documents hold are repeated: all their lines go, except
in the document of largest id that holds them.

``LineRuns`` is the index, in the manner of a log-structured merge tree. A run is a table of 128-bit key hashes,
bucketed and sorted by hash, with the number of documents so far (up to ``MIN_DOCS``, more does not matter) and the largest id.
A new batch is aggregated by key and merge-joined with every run, bucket by bucket, without moving the runs. Keys
whose record cannot change any more by this batch (repeated already, a larger id known) are anti-joined away, the
others are written as a run of level 0 with their totals so far. ``FANOUT`` runs of a level are
compacted into one of the next, so a key is rewritten once a level and a batch meets ``FANOUT - 1`` runs a
level at most. Totals only grow, so the record of a key is the largest of its runs, in whatever order batches come.

All work is DataFrame functions; no Python runs on the executors. A line that a third of all documents hold is
counted where it is read before its count moves, and its holders are dealt into ``SALT`` parts when they learn of it. The documents' texts move once, beside the positions of
their lines to be dropped.

Defined cases: a NULL or empty text is one empty line. Rows of equal id are one document; all their copies of a line stay or go
together. Rows of NULL id are one document, smaller than any id. A key may repeat within its keeper;
all of these lines stay. Where every line goes, the kept text is empty. Other columns are ignored. An empty
table gives an empty result. Ids that repeat must come in the same batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import discard, materialize
from shelfwise.session import scratch_path

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches that ``dedup`` deals a table into, and runs of a level that become one of the next.
BATCHES, FANOUT = 8, 4
#: Keys that one bucket of the runs is planned for.
BUCKET_KEYS, MAX_BUCKETS = 1_000_000, 50_000
#: Parts that the holders of a repeated line are dealt into.
SALT = 16
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h", "g"]


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_SPACE))
    # where a code point is a byte, all letters are ASCII and the faster function does the same
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, pos, h, g``: one row per line that is long enough."""
    lines = docs.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))


class LineRuns:
    """Levelled sorted runs of line hashes: ``h, g, docs`` (up to ``min_docs``) and ``last`` (largest id)."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[str]] = []
        self._places: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self._places[name] = scratch_path(self.spark, "line-run")
        rows.select("h", "g", "docs", "last").write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH) \
            .option("path", self._places[name]).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self._places.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        # read by path: a union of bucketed scans counts as partitioned by key (Spark 4.1), yet its partitions are not merged
        rows = self.spark.read.schema("h long, g long, docs int, last long").parquet(*[self._places[name] for name in names])
        return rows.repartition(self.buckets, *_HASH).groupBy(*_HASH).agg(F.max("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch (``doc_id, h, g``) with the runs and add what it changes as a run."""
        own = keys.select("doc_id", *_HASH).distinct().groupBy(*_HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
        own = own.repartition(self.buckets, *_HASH)
        docs, last = [], []
        for at, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(*_HASH, F.col("docs").alias(f"docs{at}"), F.col("last").alias(f"last{at}"))
            own = own.join(run, _HASH, "left")
            docs.append(F.col(f"docs{at}"))
            last.append(F.col(f"last{at}"))
        if docs:
            known = F.coalesce(F.greatest(F.lit(0), *docs), F.lit(0))
            least = F.greatest(F.lit(None).cast("long"), *last)
            settled = (known >= self.min_docs) & (F.col("last").isNull() | (least >= F.col("last")))
            own = own.where(~F.coalesce(settled, F.lit(False))) \
                .select(*_HASH, (F.col("docs") + known).alias("docs"), F.greatest("last", least).alias("last"))
        self._write(own.withColumn("docs", F.least("docs", F.lit(self.min_docs)).cast("int")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._forget(full)
            level += 1

    def repeated(self) -> DataFrame:
        """``h, g, last`` of the keys that enough documents hold."""
        names = [n for level in self.levels for n in level]
        return self._merged(names).where(F.col("docs") >= self.min_docs).select(*_HASH, "last")

    def close(self) -> None:
        self._forget([n for level in self.levels for n in level])
        self.levels = []


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          batches: int = BATCHES, fanout: int = FANOUT, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = scratch_path(spark, "line-keys")
    line_keys(docs, min_chars).withColumn("batch", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int")) \
        .write.partitionBy("batch").parquet(place)
    keys = spark.read.schema("doc_id long, text_hash long, pos int, h long, g long, batch int").parquet(place)
    runs = LineRuns(spark, min(MAX_BUCKETS, 1 + keys.count() // bucket_keys), min_docs, fanout)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch))
    spread = runs.repeated().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    gone = keys.withColumn("salt", F.pmod("text_hash", F.lit(SALT)).cast("int")).join(spread, [*_HASH, "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("last"))) \
        .groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.collect_set("pos").alias("gone"))
    gone = materialize(gone, "line-gone")
    runs.close()
    discard(spark, place)
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined = docs.withColumn("text_hash", _text_hash(F.col("text"))) \
        .join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")), "left")
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")).alias("kept"))

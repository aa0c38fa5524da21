"""Dictionary-compressed WARC archives: writing them from pages, and reading them back.

Every page becomes one WARC/1.1 record. A Zstandard dictionary is built from the records of
an archive, embedded in a leading skippable frame, and every record is compressed as a frame of
its own, so a reader can start at any record. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes, the one with the smallest id is written as ``response``, the others as
``revisit`` records that name it and carry no payload.

The archives are written by Spark's own text writer with its commit protocol, to any file system
that Spark knows: a row is a frame, and the line separator is an empty skippable frame, which
Zstandard readers pass over. A file is a valid ``.warc.zst`` archive.

A partition writes archive after archive, each of bounded size; a reader holds one at a time and
passes its bytes to the decompressor once.

Which pages revisit is decided on digests alone: counts and smallest ids are pre-aggregated
per digest, so a payload that a third of all pages share costs a row per task.

Defined cases: a NULL payload is empty. Repeated rows of one id and payload are all ``response`` (none is
smaller), or all ``revisit``. A page without id never becomes a ``response`` that others refer to,
unless no page of that payload has one; then all of them are ``response``. An empty table gives no
archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import ship
from shelfwise.session import scratch_path

MIN_REVISIT = 100
#: Size of a dictionary, and bytes of records that it is built from at most.
DICTIONARY_BYTES, SAMPLE_BYTES = 48 << 10, 2 << 20
LEVEL = 3
#: Records of an archive, and bytes of records from which on it ends earlier.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 4096, 64 << 20
#: Skippable frame numbers of the dictionary and of the separator.
DICTIONARY_MAGIC, SEPARATOR = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
RECORD_DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    body = payload
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """``page_id, payload length, payload digest, type, refers_to`` of a record; a response's payload is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(body):] != b"\r\n\r\n":
        raise ValueError("broken WARC record")

    def number(name: str):
        value = fields[name][len("<urn:page:"):-1]
        return int(value) if value else None

    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(body).hexdigest() != digest or len(body) != length:
            raise ValueError("payload does not match its digest")
        return number("WARC-Record-ID"), len(body), hashlib.sha256(body).hexdigest(), "response", None
    return number("WARC-Record-ID"), length, digest, "revisit", number("WARC-Refers-To")


def train_dictionary(records: list[bytes]) -> bytes | None:
    """A dictionary from archived records; None where they are too few or too small for one."""
    if len(records) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's skippable frame (empty without one), then one frame per record."""
    first, size = [], 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return
    raw = train_dictionary(first)
    if raw is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(raw)
        yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
    else:
        yield b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True,
                                          dict_data=zstandard.ZstdCompressionDict(raw) if raw is not None else None)
    for record in first:
        yield compressor.compress(record)
    first.clear()
    for record in records:
        yield compressor.compress(record)


def archives(records: Iterator[bytes], most: int, most_bytes: int) -> Iterator[bytes]:
    """Frames of one archive after the other, each of ``most + 1`` frames, so that a writer that counts rows starts a file with
    every archive. An archive that reaches ``most_bytes`` earlier is filled up with empty frames."""
    head = next(records, None)
    while head is not None:
        taken = []

        def part(first: bytes) -> Iterator[bytes]:
            nonlocal head
            size = 0
            record: bytes | None = first
            while record is not None:
                taken.append(None)
                size += len(record)
                yield record
                if len(taken) == most or size >= most_bytes:
                    break
                record = next(records, None)
            head = next(records, None) if record is not None else None

        yield from frames(part(head))
        if head is not None:
            yield from (b"" for _ in range(most - len(taken)))


#: Bytes that the reader hands to the decompressor first, and at most, at a time.
_SLICE, _LARGEST_SLICE = 1 << 12, 1 << 20


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive; what is read past a frame's end is at most as long as the frame, or one slice."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, = struct.unpack_from("<I", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            length, = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = zstandard.ZstdDecompressor().decompress(view[8:8 + length])
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + length
            continue
        reader, out, step = decompressor.decompressobj(), [], _SLICE
        while not reader.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            piece = view[at:at + step]
            out.append(reader.decompress(piece))
            at += len(piece)
            step = min(2 * step, _LARGEST_SLICE)
        at -= len(reader.unused_data)
        yield b"".join(out)


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to`` of each page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    # Decided on ids and digests; payloads move once, by page, where no key is frequent.
    slim = base.where(F.length("payload") >= MIN_REVISIT).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    again = slim.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))) \
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    return base.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write archives of at most ``ARCHIVE_RECORDS`` records and about ``ARCHIVE_BYTES`` under ``path``."""
    ship(pages.sparkSession)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                        yield record_bytes(*row)

        out, size = [], 0
        for frame in archives(records(), ARCHIVE_RECORDS, ARCHIVE_BYTES):
            out.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    plan_records(pages).mapInArrow(archive, "frame binary").select(F.col("frame").cast("string")) \
        .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_RECORDS + 1).text(path)


_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [parse_record(r) for r in read_archive(batch.column(0)[k].as_py())]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, _RESULT)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared scratch folder and return what reading them back gives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)

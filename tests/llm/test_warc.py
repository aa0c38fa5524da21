from __future__ import annotations

import glob
import hashlib

import pytest
import zstandard

from shelfwise.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def want(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        again = f is not None and (i is None or f < i)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big = "<html><body>" + "copied passage " * 20 + "</body></html>"
    rows = [(k, f"http://x/{k}", f"<html><p>page {k} of many é</p></html>" * (1 + k % 5)) for k in range(200)]
    rows += [(1000 + k, "http://copy/", big) for k in range(90)] + [(999, None, big), (3, "http://x/3", rows[3][2]), (1001, "u", big)]
    rows += [(2000, "http://nul", None), (2001, "a\r\nb", ""), (2002, "u", "\r\n\r\nWARC/1.1\r\n\x00"), (2003, "u", "x" * 3_000_000), (None, "u", big)]
    got = sorted([tuple(r) for r in warc.archive_and_read(pages(spark, rows)).collect()], key=str)
    assert got == want(rows)
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_archives_are_frames_behind_a_dictionary(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<html><p>text number {k} with a common tail of many words</p></html>" * 4) for k in range(300)]
    warc.write_archives(pages(spark, rows).repartition(2), str(tmp_path / "a"))
    seen = 0
    for name in glob.glob(str(tmp_path / "a" / "part-*")):
        data = open(name, "rb").read()
        if not data:
            continue
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        records = list(warc.read_archive(data))
        seen += len(records)
        assert all(r.startswith(b"WARC/1.1\r\n") for r in records)
        with pytest.raises(zstandard.ZstdError):  # without the dictionary the records cannot be read
            list(warc.read_archive(warc.SEPARATOR.encode() + data[8 + int.from_bytes(data[4:8], "little"):]))
    assert seen == 300


def test_broken_payload_is_noticed():
    good = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    assert warc.parse_record(good)[:2] == (1, 7)
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"))


@pytest.mark.parametrize("most,most_bytes", [(16, 1 << 20), (64, 3000)])
def test_archives_are_bounded(spark, tmp_path, monkeypatch, most, most_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", most)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", most_bytes)
    rows = [(k, "u", f"<p>page {k} of several</p>" * (1 + k % 4)) for k in range(101)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "a"))
    files = [open(name, "rb").read() for name in glob.glob(str(tmp_path / "a" / "part-*"))]
    held = [[warc.parse_record(r)[0] for r in warc.read_archive(data)] for data in files if data]
    assert len(held) > 5 and max(map(len, held)) <= most
    assert sorted(i for h in held for i in h) == list(range(101))
    assert sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()) == list(range(101))


def test_reading_is_linear():
    """Twice the records, twice the bytes that the decompressor is given."""
    class Counting:
        given = 0

        def __init__(self, real):
            self.real = real

        def decompressobj(self):
            outer, inner = self, self.real.decompressobj()

            class Reader:
                eof = property(lambda _: inner.eof)
                unused_data = property(lambda _: inner.unused_data)

                def decompress(self, data):
                    outer.given += len(data)
                    return inner.decompress(data)

            return Reader()

    work = []
    for n in (400, 800):
        records = [warc.record_bytes(k, "u", f"payload {k}".encode() * 700, "0", "revisit", k) for k in range(n)]
        data = b"".join(warc.frames(iter(records)))
        counter = Counting(zstandard.ZstdDecompressor())
        body = data[8 + int.from_bytes(data[4:8], "little"):]
        raw = zstandard.ZstdDecompressor().decompress(data[8:8 + int.from_bytes(data[4:8], "little")])
        counter.real = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        real = warc.zstandard.ZstdDecompressor
        warc.zstandard.ZstdDecompressor = lambda **_: counter
        try:
            assert list(warc.read_archive(body)) == records
        finally:
            warc.zstandard.ZstdDecompressor = real
        work.append(counter.given)
    assert work[1] <= 2.3 * work[0]


def test_cut_archive_is_noticed():
    data = b"".join(warc.frames(iter([warc.record_bytes(1, "u", b"payload", "0", "revisit", 1)])))
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-5]))

import base64
import hashlib
import io
import os
import struct
from collections import Counter, defaultdict

import pytest
import zstandard

from turnscale.llm import warc

SCHEMA = "page_id long, url string, html string, first string, same string, payload string"


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5 + 1)) for i in range(60)]
    rows += [(100, "http://x\r\nWARC-Type: evil", None), (101, None, ""), (None, "http://n", "<p>0</p>"), (None, None, None), (3, "http://h/3b", "<p>3</p>" * 4)]
    rows += [(200, "http://big", "ü" * 400_000), (9_007_199_254_740_993, "http://id", "large id")]
    return spark.createDataFrame([(*r, "f", "s", "p") for r in rows], SCHEMA)


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 28), (9, 300)])
def test_round_trip(spark, least, size):
    given = pages(spark).collect()
    rows = warc.archive_round_trip(pages(spark).repartition(3), least_revisit_bytes=least, archive_bytes=size).collect()
    first = defaultdict(lambda: None)
    for r in given:
        body = (r.html or "").encode()
        if r.page_id is not None and len(body) >= least:
            first[body] = r.page_id if first[body] is None else min(first[body], r.page_id)
    want = Counter()
    for r in given:
        body = (r.html or "").encode()
        again = r.page_id is not None and first[body] is not None and first[body] != r.page_id
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[r.page_id, len(body), digest, "revisit" if again else "response", first[body] if again else None, r.url and warc.one_line(r.url)] += 1
    assert Counter(map(tuple, rows)) == want
    assert warc.archive_round_trip(pages(spark).filter("false")).count() == 0


def test_payloads_and_dictionary(spark, tmp_path):
    manifest = warc.write_archives(pages(spark).coalesce(1), f"file://{tmp_path}/a")
    (path,) = [r.path for r in manifest.collect()]
    data = open(path.removeprefix("file://"), "rb").read()
    assert data[:4] == warc.DICTIONARY_MAGIC and len(os.listdir(f"{tmp_path}/a")) == 1
    size = struct.unpack("<I", data[4:8])[0]
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    frames = zstandard.ZstdDecompressor(dict_data=trained)
    assert frames.decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")
    kept = {r.page_id: r.payload for r in warc.read_archives(manifest, payloads=True).collect() if r.page_id is not None and r.record_type == "response"}
    assert kept[200] == ("ü" * 400_000).encode()


def test_broken_archives():
    out = io.BytesIO()
    out.close_really, out.close = out.close, lambda: None
    writer = warc.ArchiveWriter(out, 3)
    for i in range(20):
        writer.add(warc.build_record(i, "http://a", b"some text %d" % i, None, "2024-01-01T00:00:00Z"))
    writer.close()
    data = out.getvalue()
    records = list(warc.read_frames(io.BytesIO(data)))
    assert [warc.parse_record(r)["page_id"] for r in records] == list(range(20))
    for cut in (2, 6, 20, len(data) - 3):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(data[:cut])))
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"some", b"sane"), good.replace(b"WARC-Type: response\r\n", b""), good + b"x", good.replace(b"Content-Length: ", b"Content-Length: 9")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    skippable = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert len(list(warc.read_frames(io.BytesIO(data + skippable)))) == 20


def test_frames_that_grow_too_large():
    bomb = zstandard.ZstdCompressor(level=3).compress(b"a" * 50_000_000)
    unknown = zstandard.ZstdCompressor(level=3, write_content_size=False).compressobj()
    hidden = unknown.compress(b"a" * 50_000_000) + unknown.flush()
    assert zstandard.frame_content_size(hidden) == -1
    for data in (bomb, hidden):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(data), most=1_000_000))
        assert [len(x) for x in warc.read_frames(io.BytesIO(data + data))] == [50_000_000] * 2
    many = b"".join([small.compress(os.urandom(5000)) + small.flush() for small in [zstandard.ZstdCompressor(write_content_size=False).compressobj() for _ in range(30)]])
    assert [len(x) for x in warc.read_frames(io.BytesIO(many))] == [5000] * 30


def test_an_empty_page_that_most_pages_have(spark):
    rows = [(i, "u", None if i % 3 else "", "f", "s", "p") for i in range(500)] + [(7, "v", "other", "f", "s", "p")]
    found = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter((r.record_type, r.refers_to) for r in found) == {("response", None): 2, ("revisit", 0): 499}
    names = spark.createDataFrame([], SCHEMA + ", of string, digest string, refers_to string")
    assert warc.archive_round_trip(names).count() == 0

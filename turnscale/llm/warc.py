"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bound_batches, saved, scratch

#: Fixed values of the format: the magic numbers of a skippable dictionary frame and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PAGE_URN = "urn:x-page:"
#: Bytes read at once, of a sample for a dictionary, of a dictionary, and of records after which an archive is closed.
CHUNK, SAMPLE, DICTIONARY, ARCHIVE = 1 << 16, 1 << 20, 1 << 15, 256 << 20

MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


class WarcError(ValueError):
    """An archive that doesn't hold what its format promises."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(value: str) -> str:
    """A header value may not hold line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or the revisit of another page's; the HTTP head of either has the payload's length."""
    digest, revisit = base32_sha1(payload), refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"{PAGE_URN}{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {digest}").urn
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", one_line(url)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + END


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary for records like these; none if too few of them are no longer than a dictionary."""
    import zstandard

    sample = [r for r in records if len(r) <= DICTIONARY]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample, k=256, d=8).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a stream; the first SAMPLE bytes of them wait for the dictionary that they train."""

    def __init__(self, out: BinaryIO, level: int):
        self.out, self.level, self.frames, self.waiting, self.size = out, level, None, [], 0
        self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.size += len(record)
        if self.frames is not None:
            self.out.write(self.frames.compress(record))
            return
        self.waiting.append(record)
        if self.size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        import zstandard

        data = train_dictionary(self.waiting)
        if data:
            packed = zstandard.ZstdCompressor(level=self.level).compress(data)
            self.out.write(DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed)
        trained = zstandard.ZstdCompressionDict(data) if data else None
        self.frames = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for record in self.waiting:
            self.out.write(self.frames.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.frames is None:
            self._start()
        self.out.close()


def write_archives(pages: DataFrame, path: str, least_revisit_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to archives under path; returns their manifest.

    Of equal payloads of at least least_revisit_bytes, the one of smallest page_id is a response and the others
    revisit it. A null html is an empty payload, a null url leaves the target out; rows of null page_id are
    responses with an id of their own kind; rows that repeat the smallest page_id are all responses. An empty table
    gives no archive. Other columns are not read.

    A task writes archives under names of its own and lists each after closing it. The manifest (path, records,
    bytes) is a table, so it has each partition's archives from just one successful attempt; what lost or repeated
    attempts have left is in no manifest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.filter("page_id is not null").select("page_id", F.sha1(payload).alias("same"), F.octet_length(payload).alias("n"))
    groups = slim.filter(F.col("n") >= least_revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # Ids and digests alone meet the groups; a payload that many pages have is no key of the join that moves payloads.
    copies = slim.join(groups.filter("copies > 1").select("same", "first"), "same").filter("page_id != first").select("page_id", "same", "first").distinct()
    copies = saved(copies.select(F.col("page_id").alias("of"), F.col("same").alias("digest"), F.col("first").alias("refers_to")), "page-copies")
    rows = bound_batches(pages).select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("same"))
    rows = rows.join(copies, (F.col("page_id") == F.col("of")) & (F.col("same") == F.col("digest")), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        archive, name, done = None, "", []
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = ArchiveWriter(files.open_output_stream(f"{base}/{name}", compression=None), level)
                archive.add(build_record(*[value.as_py() for value in row], date))
                if archive.size >= archive_bytes:
                    archive.close()
                    done.append((f"{path}/{name}", archive.records, archive.size))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((f"{path}/{name}", archive.records, archive.size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d, strict=True)) for d in done], MANIFEST)

    make_dir(path)
    return saved(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def make_dir(path: str) -> None:
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)


#: Bytes of a record at most, unless told otherwise, and bytes of a frame of unknown size that are decoded at once.
MOST_RECORD, PIECE = 1 << 30, 1 << 10


def read_frames(stream: BinaryIO, most: int = MOST_RECORD) -> Iterator[bytes]:
    """The content of every frame but skippable ones, which are passed over; the leading one may hold the dictionary.

    A frame of over `most` bytes, or a dictionary of as many, raises WarcError before it takes that much memory.
    """
    import zstandard

    def checked(data: bytes) -> int:
        """The size that a frame's head tells; -1 if it doesn't."""
        try:
            size = zstandard.frame_content_size(data)
        except zstandard.ZstdError as error:
            raise WarcError(f"a broken frame: {error}") from error
        if size > most:
            raise WarcError(f"a frame of {size} bytes; {most} are the most")
        return size

    buffer = b""

    def need(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n:
            if not (more := stream.read(CHUNK)):
                return False
            buffer += more
        return True

    decoder, first = zstandard.ZstdDecompressor(), True
    while need(1):
        if not need(4):
            raise WarcError("the archive ends within a magic number")
        if 0x184D2A50 <= struct.unpack("<I", buffer[:4])[0] <= 0x184D2A5F:
            if not need(8) or not need(8 + (size := struct.unpack("<I", buffer[4:8])[0])):
                raise WarcError("the archive ends within a skippable frame")
            if first and buffer[:4] == DICTIONARY_MAGIC:
                data = buffer[8 : 8 + size]
                data = zstandard.ZstdDecompressor().decompress(data, max_output_size=most) if data[:4] == FRAME_MAGIC and checked(data) else data
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            buffer = buffer[8 + size :]
        else:
            need(18)  # the longest head
            frame, parts, size, known = decoder.decompressobj(), [], 0, checked(buffer) >= 0
            while True:
                # A frame that tells its size can't give more; of others little is decoded before their size is looked at.
                now, later = (buffer, b"") if known else (buffer[:PIECE], buffer[PIECE:])
                try:
                    parts.append(frame.decompress(now))
                except zstandard.ZstdError as error:
                    raise WarcError(f"a broken frame: {error}") from error
                if (size := size + len(parts[-1])) > most:
                    raise WarcError(f"a frame of over {most} bytes")
                if frame.eof:
                    buffer = frame.unused_data + later
                    break
                if not (buffer := later or stream.read(CHUNK)):
                    raise WarcError("the archive ends within a frame")
            yield b"".join(parts)
        first = False


def parse_record(record: bytes) -> dict:
    """A frame's record, with its lengths and digests verified."""
    head, found, rest = record.partition(END)
    if not head.startswith(VERSION) or not found:
        raise WarcError("a frame doesn't start with a WARC head")
    fields = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"a head line without a colon: {line[:80]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise WarcError(f"a record lacks {sorted(missing)}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + len(END) or not rest.endswith(END):
        raise WarcError(f"a record's Content-Length is {length}, its frame has {len(rest) - len(END)} bytes")
    block = rest[: -len(END)]
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise WarcError("a block doesn't match its digest")
    http, _, payload = block.partition(END)
    said = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] != "revisit" and (said != len(payload) or digest != base32_sha1(payload)):
        raise WarcError("a payload doesn't match its length or digest")
    page = lambda name: int(x[len(PAGE_URN) :]) if (x := fields.get(name, "").strip("<>")).startswith(PAGE_URN) else None
    kind = fields["warc-type"]
    return {
        "page_id": page("warc-record-id"), "payload_bytes": said, "payload_digest": digest, "record_type": kind,
        "refers_to": page("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload,
    }


RECORD = [
    pa.field("page_id", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string()),
    pa.field("record_type", pa.string()), pa.field("refers_to", pa.int64()), pa.field("target_uri", pa.string()),
]


def read_archives(manifest: DataFrame, payloads: bool = False, rows_per_batch: int = 500) -> DataFrame:
    """Every record of the archives that a manifest (path, records, bytes) lists, verified; payload only if asked for.

    An archive is read as a stream by one task, a record at a time. Anything broken, or another number of records
    than listed, raises WarcError. An empty manifest gives no rows.
    """
    schema = pa.schema([*RECORD, pa.field("payload", pa.binary())] if payloads else RECORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive in batch.to_pylist():
                files, name = fs.FileSystem.from_uri(archive["path"])
                rows, count = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for content in read_frames(stream):
                        rows.append(parse_record(content))
                        count += 1
                        if len(rows) >= rows_per_batch:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if count != archive["records"]:
                    raise WarcError(f"{archive['path']} has {count} records, not {archive['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    archives = manifest.select("path", "records")
    spread = archives.repartitionByRange(max(1, archives.count()), "path")
    return spread.mapInArrow(run, from_arrow_schema(schema))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read every record back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), **options))

"""WARC records in ZIP-packaged archives: stored members, a record index, range reads.

An archive is a ZIP of stored members: under archive/ WARC files with one gzip member for each record, under indexes/ CDXJ
files, a line for each record (key, timestamp, JSON) with the file, offset and length of it. The reader finds them all through
the end records and the central directory (ZIP64 included) and reads single records by range; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, open_fs, shared_path, write_whole

#: Fixed values of the formats.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
M32, M16 = 0xFFFFFFFF, 0xFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Record bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Payloads below this many bytes are never revisits.
LEAST = 100


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    at: int


class ZipSink:
    """Bytes of a ZIP of stored members, streamed: sizes follow a member's data and stand in the central directory."""

    def __init__(self, always64: bool = False) -> None:
        self.at, self.members, self.always64 = 0, [], always64

    def member(self, name: str, chunks: Iterable[bytes]) -> Iterator[bytes]:
        raw = name.encode()
        entry = Member(name, 0, 0, 0, self.at)
        self.members.append(entry)
        yield self._out(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, M32, M32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        for chunk in chunks:
            entry.crc = zlib.crc32(chunk, entry.crc)
            entry.size += len(chunk)
            yield self._out(chunk)
        yield self._out(struct.pack("<4sIQQ", DESCRIPTOR, entry.crc, entry.size, entry.size))

    def end(self) -> Iterator[bytes]:
        start = self.at
        for m in self.members:
            raw, big = m.name.encode(), self.always64 or m.size >= M32 or m.at >= M32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.at) if big else b""
            size, at = (M32, M32) if big else (m.size, m.at)
            yield self._out(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        size, n = self.at - start, len(self.members)
        big = self.always64 or start >= M32 or size >= M32 or n >= M16
        if big:
            yield self._out(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", LOCATOR64, 0, start + size, 1))
        yield self._out(struct.pack("<4sHHHHIIH", END, 0, 0, M16 if big else n, M16 if big else n, M32 if big else size, M32 if big else start, 0))

    def _out(self, chunk: bytes) -> bytes:
        self.at += len(chunk)
        return chunk


class ZipRanges:
    """Members of a ZIP by range reads: read(at, size) -> bytes."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        tail_at = max(0, size - 22 - M16)
        tail = read(tail_at, size - tail_at)
        k = tail.rfind(END)
        while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):  # the signature may also stand in a comment
            k = tail.rfind(END, 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, k + 10)
        if n == M16 or length == M32 or start == M32:
            mark, _, at, _ = struct.unpack("<4sIQI", read(tail_at + k - 20, 20))
            if mark != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            mark, *_, n, length, start = struct.unpack("<4sQHHIIQQQQ", read(at, 56))
            if mark != END64:
                raise ValueError("no ZIP64 end of central directory")
        directory, at = read(start, length), 0
        self.members: dict[str, Member] = {}
        for _ in range(n):
            mark, method, crc, packed, plain, name_n, extra_n, note_n, where = struct.unpack_from("<4s6xH4xIIIHHH8xI", directory, at)
            if mark != CENTRAL:
                raise ValueError("bad central directory")
            name = directory[at + 46 : at + 46 + name_n].decode()
            extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
            wide, e = iter(()), 0
            while e + 4 <= len(extra):
                kind, size_ = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, e + 4))
                e += 4 + size_
            plain, packed, where = (next(wide) if x == M32 else x for x in (plain, packed, where))
            self.members[name] = Member(name, method, crc, packed, where)
            at += 46 + name_n + extra_n + note_n

    def data_at(self, name: str) -> int:
        """Where a stored member's bytes begin: its local header's own name and extra lengths decide."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name}: compressed members can't be read by range")
        mark, name_n, extra_n = struct.unpack("<4s22xHH", self.read(m.at, 30))
        if mark != LOCAL:
            raise ValueError(f"{name}: bad local header")
        return m.at + 30 + name_n + extra_n

    def range(self, name: str, at: int, size: int) -> bytes:
        if at < 0 or at + size > self.members[name].size:
            raise ValueError(f"{name}: range outside the member")
        return self.read(self.data_at(name) + at, size)


def _header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (lower-case names), HTTP headers and payload of one plain record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return fields, web, payload


def url_key(url: str | None) -> str:
    """A URL's sort key: host parts from the top, then the path; - without a host."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    if not host:
        return "-"
    tail = parts.path.lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return re.sub(r"[\s{}]", lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + ")" + (tail or "/"))


def archive_bytes(records: Iterable[tuple[str | None, bytes]], always64: bool = False) -> Iterator[bytes]:
    """records: (url, plain record) -> the archive's bytes."""
    sink, lines, name = ZipSink(always64), [], DATA.rpartition("/")[2]

    def packed():
        at = 0
        for url, raw in records:
            member = gzip.compress(raw, 4, mtime=0)
            lines.append((url_key(url), f"{url_key(url)} 19700101000000 {json.dumps({'url': _header(url or ''), 'filename': name, 'offset': str(at), 'length': str(len(member))})}\n"))
            at += len(member)
            yield member

    yield from sink.member(DATA, packed())
    yield from sink.member(INDEX, (line.encode() for _, line in sorted(lines)))
    yield from sink.end()


def indexed_records(archive: ZipRanges) -> list[tuple[str, int, int]]:
    """(member, offset, length) of every record that the archive's indexes name, in order, each once.

    A line's file is a member under archive/; a line that names none is of the only one there.
    """
    data = [m for m in archive.members if m.startswith("archive/") and not m.endswith("/")]
    found = set()
    for name, member in archive.members.items():
        if not name.startswith("indexes/") or name.endswith("/"):
            continue
        raw = archive.range(name, 0, member.size)
        for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).splitlines():
            at = line.find(b"{")
            if at < 0 or line.startswith(b"!"):
                continue  # a header or a blank line
            row = json.loads(line[at:])
            file = row.get("filename")
            target = data[0] if file is None and len(data) == 1 else next((m for m in data if m in (file, f"archive/{file}")), None)
            if target is None:
                raise ValueError(f"{name}: a record of {file}, which the archive does not hold")
            found.add((target, int(row["offset"]), int(row["length"])))
    return sorted(found)


def archive_records(read, size: int, run: int = 4 << 20) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record of an archive, by range reads of runs of neighbouring records."""
    archive = ZipRanges(read, size)
    index, k = indexed_records(archive), 0
    while k < len(index):
        member, first, _ = index[k]
        end = k + 1
        while end < len(index) and index[end][0] == member and index[end][1] + index[end][2] - first <= run:
            end += 1
        data = archive.range(member, first, max(at + n for _, at, n in index[k:end]) - first)
        for _, at, n in index[k:end]:
            raw = data[at - first : at - first + n]
            yield parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        k = end


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> (uri, records): archives written to the shared folder.

    Of equal payloads of at least LEAST bytes the row with the smallest id is the response (each of them, if rows repeat
    it); the others are revisits of it. Null html is an empty payload, null url leaves its header out, a null id is
    written as such and never a response that others revisit. An empty table writes no archive.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 250)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    folder = shared_path(spark, "warc")
    out = pa.schema([("uri", pa.string()), ("records", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        stream = ((row[1], warc_record(*row)) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, number = next(stream, None), 0
        while held is not None:
            done = [0, 0]

            def some(done=done):
                """Records of one archive; the one that it has no room for stays in held."""
                nonlocal held
                while held is not None and (not done[0] or done[1] < ARCHIVE_BYTES):
                    yield held
                    done[0], done[1] = done[0] + 1, done[1] + len(held[1])
                    held = next(stream, None)

            uri = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            write_whole(uri, archive_bytes(some()))
            yield arrow_rows(out, [[uri], [done[0]]])
            number += 1

    made = sorted(rows.mapInArrow(write, "uri string, records long").collect())  # a row for each archive
    return spark.createDataFrame([tuple(x) for x in made], "uri string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """archives(uri) -> (page_id, payload_bytes, payload_digest, record_type, refers_to) per record; a stored payload must match its digest."""
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        value = urn[len("<urn:page:") : -1] if urn else "None"
        return None if value == "None" else int(value)

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                filesystem, path = open_fs(uri)
                with filesystem.open_input_file(path) as source:
                    rows = []
                    for fields, web, payload in archive_records(lambda at, n: source.read_at(n, at), source.size()):
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{uri}: payload of {fields['warc-record-id']} does not match its digest")
                        rows.append((number(fields["warc-record-id"]), int(web["content-length"]), digest, kind, number(fields.get("warc-refers-to"))))
                    if rows:
                        yield arrow_rows(out, list(zip(*rows, strict=True)))

    return archives.select("uri").repartition(max(archives.count(), 1)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND strlen(p.h) >= 100
"""

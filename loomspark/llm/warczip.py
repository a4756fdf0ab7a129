"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds *stored* members only: ``archive/data.warc.gz``, one gzip member
per WARC record, and ``indexes/index.cdx``, a line per record with its offset and
length.  The reader finds the central directory from the end of the file (by the
ZIP64 records where the classic ones overflow), resolves each member's local
header, and reads single records by range.

Files are reached through ``pyarrow.fs`` by URI, so packages lie in whatever
store the session shares.  A writing task names its files freely and returns
them as rows; only packages of rows that Spark committed are ever read, so a
task that runs twice leaves nothing behind that counts.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import fresh_path, written

#: Payloads from this size on are written once and revisited (fixed by the contract).
REVISIT_FROM = 1000
#: Bytes after which a package is closed and the next begun.
PACKAGE_BYTES = 64 << 20
#: Bytes read at once from a package; records within are cut from memory.
READ_BYTES = 4 << 20
#: Groups of equal payloads are spread over so many salts when pages look up their response.
SALTS = 16

_EPOCH = "1980-01-01T00:00:00Z"
_CRLF = b"\r\n"


# ------------------------------------------------------------------------------ ZIP

_LOCAL, _CENTRAL, _END, _END64, _LOC64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_DATE = (1 << 5) | 1  # 1980-01-01
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int  # offset of the local header


class StoredZipWriter:
    """Writes stored members front to back into a stream that can not seek.

    Sizes follow the data (bit 3 of the flags), always as ZIP64.
    """

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [name, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x808, 0, 0, _DATE, 0, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)

    def end(self) -> None:
        name, header, crc, size = self.open
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append(Member(name, 0, crc, size, header))
        self.open = None

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, extra = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x808, 0, 0, _DATE, m.crc, _FULL32, _FULL32, len(raw), len(extra), 0, 0, 0, 0, _FULL32) + raw + extra)
        size, here, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", _LOC64, 0, here, 1))
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0))


class ZipReader:
    """Random access to the stored members of a package through ``seek`` and ``read``."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        self.length = file.tell()
        self.members = {m.name: m for m in self._directory()}

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"package ends at {self.length}, {size} bytes wanted at {offset}")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - 22 - 65535)
        tail = self.at(tail_at, self.length - tail_at)
        k = len(tail) - 22
        while k >= 0 and not (tail[k : k + 4] == b"PK\x05\x06" and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
            k -= 1
        if k < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<HII", tail, k + 10)
        end_at = tail_at + k
        if end_at >= 20 and self.at(end_at - 20, 4) == b"PK\x06\x07":
            where = struct.unpack("<Q", self.at(end_at - 12, 8))[0]
            record = self.at(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator leads nowhere")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
        data, p = self.at(start, size), 0
        for _ in range(n):
            sig, _, _, flags, method, _, _, crc, packed, plain, ln, le, lc, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, p)
            if sig != _CENTRAL:
                raise ValueError("broken central directory")
            raw, extra = data[p + 46 : p + 46 + ln], data[p + 46 + ln : p + 46 + ln + le]
            plain, packed, header = _wide(extra, plain, packed, header)
            yield Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, crc, packed, header)
            p += 46 + ln + le + lc

    def data_at(self, member: Member) -> int:
        """Where a member's bytes begin; only stored members can be read by range."""
        if member.method != 0:
            raise ValueError(f"{member.name} is compressed in its package")
        sig, ln, le = struct.unpack("<I22xHH", self.at(member.header, 30))
        if sig != _LOCAL:
            raise ValueError(f"{member.name} has no local header")
        return member.header + 30 + ln + le

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        m = self.members[name]
        size = m.size - start if size is None else size
        if start < 0 or size < 0 or start + size > m.size:
            raise ValueError(f"range leaves {name}")
        return self.at(self.data_at(m) + start, size)


def _wide(extra: bytes, *values: int) -> list[int]:
    """32-bit fields, replaced by their ZIP64 values where they are full."""
    out, p = list(values), 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            q = p + 4
            for k, v in enumerate(out):
                if v == _FULL32:
                    out[k] = struct.unpack_from("<Q", extra, q)[0]
                    q += 8
        p += 4 + n
    return out


# ----------------------------------------------------------------------------- WARC


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit carries the HTTP head only and the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_EPOCH}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\n" + _CRLF.join(x.encode("utf-8", "surrogatepass") for x in lines) + b"\r\n\r\n"
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


@dataclass(frozen=True)
class Record:
    kind: str
    page_id: int | None
    url: str | None
    payload: bytes | None  # None for a revisit
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parse_record(packed: bytes) -> Record:
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.split(_CRLF) if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind, page = fields["WARC-Type"], fields["WARC-Record-ID"][10:-1]
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if digest != said or len(payload) != full:
            raise ValueError(f"record {page}: the payload does not match its digest")
    to = fields.get("WARC-Refers-To")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return Record(kind, int(page) if page else None, url, payload if kind == "response" else None, full, said, int(to[10:-1]) if to else None)


_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdx"


class Package:
    """One package being written."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = fs.open_output_stream(path)
        self.zip = StoredZipWriter(self.stream)
        self.zip.begin(_DATA)
        self.index, self.size = io.BytesIO(), 0

    def add(self, record: bytes) -> None:
        self.index.write(b"%d %d\n" % (self.size, len(record)))
        self.zip.write(record)
        self.size += len(record)

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(_INDEX)
        self.zip.write(self.index.getvalue())
        self.zip.end()
        self.zip.close()
        self.stream.close()
        return self.uri, self.size


def records(uri: str) -> Iterator[Record]:
    """All records of a package by ranges of neighbouring index lines."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        z = ZipReader(f)
        spans = [tuple(map(int, x.split())) for x in z.read(_INDEX).splitlines()]
        k = 0
        while k < len(spans):
            first = k
            while k < len(spans) and (k == first or spans[k][0] + spans[k][1] - spans[first][0] <= READ_BYTES):
                k += 1
            base = spans[first][0]
            data = memoryview(z.read(_DATA, base, spans[k - 1][0] + spans[k - 1][1] - base))
            for at, size in spans[first:k]:
                yield parse_record(bytes(data[at - base : at - base + size]))


def record_at(uri: str, number: int) -> Record:
    """One record by its place in the index; nothing else of the data is read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        z = ZipReader(f)
        at, size = map(int, z.read(_INDEX).splitlines()[number].split())
        return parse_record(z.read(_DATA, at, size))


# ---------------------------------------------------------------------------- Spark


def planned(pages: DataFrame, revisit_from: int = REVISIT_FROM, salts: int = SALTS) -> DataFrame:
    """Pages with ``payload_digest`` and, for revisits, ``refers_to``.

    The largest id of each digest is found with map-side maxima; the few digests
    that occur more than once are copied to all salts, so no digest, however
    frequent, meets in one task.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = F.octet_length("html") >= revisit_from
    groups = base.filter(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).filter("least < first")
    # small payloads look nothing up; a key of their own deals them evenly
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    spread = groups.select(F.col("digest").alias("_d"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    base = base.withColumn("salt", F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).otherwise(F.lit(-1)))
    joined = base.withColumn("_key", key).join(spread, (F.col("_key") == F.col("_d")) & (F.col("salt") == F.col("_s")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))


def write_packages(plan: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages and returns the committed ones as ``(uri, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for batch in batches:
            for page_id, url, html, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or Package(folder)
                package.add(warc_record("response" if to is None else "revisit", page_id, url, html.encode("utf-8", "surrogatepass"), digest, to))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["uri", "bytes"])

    return written(plan.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "uri string, bytes long"), "packages")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages ``(uri, ...)``, dealt by package over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: list[Record] = []
                for r in records(uri):
                    rows.append(r)
                    if len(rows) == 256:
                        yield _rows(rows, payloads)
                        rows = []
                yield _rows(rows, payloads)

    return packages.select("uri").repartition(F.col("uri")).mapInArrow(run, READ)


def _rows(rows: list[Record], payloads: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r.page_id for r in rows], pa.int64()), pa.array([r.url for r in rows], pa.string()),
            pa.array([r.payload if payloads else None for r in rows], pa.binary()), pa.array([r.payload_bytes for r in rows], pa.int64()),
            pa.array([r.payload_digest for r in rows], pa.string()), pa.array([r.kind for r in rows], pa.string()),
            pa.array([r.refers_to for r in rows], pa.int64()),
        ],
        names=[x.split()[0] for x in READ.split(", ")],
    )


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages(page_id, url, html, ...)`` as packages and reads all records back.

    Null html is an empty payload.  Pages with a null id are responses; of pages
    that share the largest id of their payload all are responses.  An empty table
    writes no package.  Other columns are not kept.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(planned(pages), folder), payloads=False)

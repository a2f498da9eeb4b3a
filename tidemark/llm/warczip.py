"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

A package is a ZIP file in the shared folder. It holds ``archive/data.warc.gz`` (each record a gzip member of its own) and
``indexes/index.cdx`` as *stored* members, so each record is a byte range of the package. The reader opens the file, takes
the end-of-directory record (or its ZIP64 form) from the tail, parses the central directory with ZIP64 extra
fields, finds all stored archives (``.warc`` or ``.warc.gz``) and indexes, reads the indexes and then only the ranges
they name; compressed members are passed over. It works on any ``read(offset, length)`` source.

A retried task writes a file of its own, and only the files that the finished tasks named are read. The folder is
reached by pyarrow's file systems from its address.

Payload: the html in UTF-8, null as empty. Of records with equal payloads the one with the largest id is
the response, the rest are revisits; repeated rows of that id are all responses. A null id is kept
and never refers to anything unless every id of its payload is null (then it is a response). An empty table gives no
packages and no rows. Only id, address and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, shared_dir, staged, staged_bytes

#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK64 = 0xFFFFFFFF
Read = Callable[[int, int], bytes]


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) | (page_id & ((1 << 64) - 1))) if page_id is not None else uuid.UUID(int=0)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record[10:-1]).int
    low = value & ((1 << 64) - 1)
    return None if not value else low - (1 << 64) if low >> 63 else low


def _uri(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "urn:none"


def write_record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, ids, payload length and digest of one record. A response's payload is hashed as read;
    its declared digest must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    else:
        size = len(payload)
        if digest(payload) != declared:
            raise ValueError("payload digest differs")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": declared, "record_type": fields["WARC-Type"], "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None}


def write_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` forces the 64-bit directory that large ones need."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= _MARK64 or at >= _MARK64
        size = _MARK64 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MARK64 if big else at) + raw + extra)
        out += [local, data]
        at += len(local) + len(data)
    directory = b"".join(central)
    tail = b""
    if big := zip64 or at >= _MARK64 or len(members) >= 0xFFFF:
        tail = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(directory), 1)
    count = 0xFFFF if big else len(members)
    return b"".join((*out, directory, tail, struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, _MARK64 if big else len(directory), _MARK64 if big else at, 0)))


def read_directory(read: Read, length: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, crc, data offset, data length), from the tail and the central directory."""
    tail_at = max(0, length - 65_557)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end-of-directory record")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == _MARK64 or start == _MARK64:
        where = tail_at + at - 20
        sign, _, end64, _ = struct.unpack("<4sIQI", read(where, 20))
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        count, size, start = struct.unpack_from("<QQQ", read(end64, 56), 32)
    directory, at, found = read(start, size), 0, {}
    for _ in range(count):
        sign, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if sign != b"PK\1\2":
            raise ValueError("bad central directory")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == _MARK64 else plain
                packed = wide.pop(0) if packed == _MARK64 else packed
                local = wide.pop(0) if local == _MARK64 else local
            extra = extra[4 + n :]
        n_local_name, n_local_extra = struct.unpack("<HH", read(local + 26, 4))
        found[name] = (method, crc, local + 30 + n_local_name + n_local_extra, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def read_package(read: Read, length: int) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, record) of each indexed record, by range reads from the package."""
    members = read_directory(read, length)
    archives = {name: m for name, m in members.items() if name.endswith((".warc", ".warc.gz")) and m[0] == 0}
    for name, (method, crc, start, size) in members.items():
        if not name.endswith(".cdx") or method:
            continue
        index = read(start, size)
        if zlib.crc32(index) != crc:
            raise ValueError("index is damaged")
        for line in index.decode().splitlines():
            archive, at, n = line.rsplit(" ", 2)
            at, n = int(at), int(n)
            if archive not in archives or at + n > archives[archive][3]:
                raise ValueError("an index names a range that no stored archive has")
            raw = read(archives[archive][2] + at, n)
            yield archives[archive][2] + at, n, parse_record(gzip.decompress(raw) if archive.endswith(".gz") else raw)


def _opened(address: str):
    """(file system, path) of an address."""
    from pyarrow import fs

    if address.startswith("file:") or "://" not in address:
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def pack_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(package, bytes): the address and length of each package written, with one record per row.

    The response of a payload is found by an aggregation with map-side combine on the digest; only payloads that
    occur twice come back to the pages, broadcast below a checked size, else by a join that adaptive execution splits."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.encode("html", "utf-8")))
    often = staged(p.groupBy(sha.alias("_sha")).agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1").select("_sha", "top"))
    right = F.broadcast(often) if staged_bytes(often) <= BROADCAST_BYTES else often
    joined = p.withColumn("sha", sha).join(right, F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "html", F.coalesce("top", "page_id").alias("top"))
    folder = f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"

    def run(batches):
        files, path = _opened(folder)
        files.create_dir(path, recursive=True)
        data, index, at = [], [], 0

        def package():
            whole = write_package([("archive/data.warc.gz", b"".join(data)), ("indexes/index.cdx", "".join(index).encode())])
            name = f"{uuid.uuid4().hex}.zip"
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(whole)
            return pa.RecordBatch.from_pydict({"package": pa.array([f"{folder}/{name}"]), "bytes": pa.array([len(whole)], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                record = write_record(row["page_id"], row["url"], payload, digest(payload), row["top"], row["top"] is not None and row["page_id"] != row["top"])
                record = gzip.compress(record, 1, mtime=0)
                data.append(record)
                index.append(f"archive/data.warc.gz {at} {len(record)}\n")
                at += len(record)
                if at >= PACKAGE_BYTES:
                    yield package()
                    data, index, at = [], [], 0
        if data:
            yield package()

    return joined.mapInArrow(run, "package string, bytes bigint")


def read_pages(packages: DataFrame) -> DataFrame:
    """Every record of each package (package, bytes), by range reads through the file system."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, ("record_offset", pa.int64()), ("record_bytes", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _opened(row["package"])
                with files.open_input_file(path) as f:
                    rows = []
                    for at, n, r in read_package(lambda o, k, f=f: f.read_at(k, o), row["bytes"]):
                        rows.append(r | {"record_offset": at, "record_bytes": n})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packages.select("package", "bytes").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_offset bigint, record_bytes bigint")


def archive_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows into packages in the shared folder, then read the packages back, dealt over all tasks."""
    packages = staged(pack_pages(pages, id_col, url_col, html_col))
    return read_pages(packages.repartition(max(1, packages.count())))

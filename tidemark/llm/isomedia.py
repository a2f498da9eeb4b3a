"""ISO media containers: write, walk nested boxes, decode sample tables, range-read samples.

``write_media`` stores a payload as raw 8-bit samples, 64 to a frame, in a movie file: ``ftyp``, then
``moov`` with the sample tables, then ``mdat``. ``read_media`` walks the boxes of a file whose movie box holds
its sample tables (``stsz`` or compact ``stz2`` sizes, 32- or 64-bit offsets) and takes codec, time scale, duration,
sizes, offsets and sync samples from them; key frames come out as byte ranges and no payload is decoded. Composition
offsets do not move bytes and are not read. Movies in fragments have empty tables: their features are null, as
are those of a damaged file; counts are checked against the box that holds them before anything is allocated.

Null or empty text is a payload of 64 zero bytes. Equal texts give equal files (no clock, no ids). Repeated rows and
ids are rows of their own, an empty table gives no rows. Only the id and the named column are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME = 64
FRAMES_PER_CHUNK = 64
KEY_EVERY = 16
TIMESCALE = 8000
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the frame size."""
    return payload.ljust(max(1, -(-len(payload) // FRAME)) * FRAME, b"\0")


def write_media(payload: bytes) -> bytes:
    """A movie file whose single track holds ``payload`` (a multiple of 64 bytes)."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    rest = frames - (chunks - 1) * FRAMES_PER_CHUNK
    duration = min(len(payload), (1 << 32) - 1)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != FRAMES_PER_CHUNK)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", struct.pack(">6xH8xHH4xI", 1, 1, 8, TIMESCALE << 16))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6")

    def movie(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = (first + np.arange(chunks, dtype=np.uint64) * (FRAME * FRAMES_PER_CHUNK)).astype(">u8" if wide else ">u4")
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7), media)
        header = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", header, track)

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    start = len(head) + len(movie(0)) + lead
    return head + movie(start) + _box(b"mdat", payload)


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, outer before inner; raises ValueError on a bad size."""
    stack = [(start, len(data) if end is None else end, path)]
    while stack:
        at, stop, path = stack.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            raise ValueError(f"box {kind!r} at {at} has a bad size")
        stack.append((at + size, stop, path))
        yield (*path, kind), body, at + size
        if kind in CONTAINERS:
            stack.append((body, at + size, (*path, kind)))


def _table(data: bytes, body: int, end: int, columns: int, wide: bool = False) -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, body + 4)
    if body + 8 + count * columns * (8 if wide else 4) > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, dtype=">u8" if wide else ">u4", count=count * columns, offset=body + 8).reshape(count, columns).astype(np.int64)


def read_media(data: bytes) -> list[dict]:
    """One dict per track: codec, timescale, duration, bits, samples, the byte range of each run of
    adjacent samples, and of each sync sample. Touches only the tables, never the payload."""
    tracks: list[dict] = []
    for path, body, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 0, "duration": 0, "keys": None, "bits": 0})
        if not tracks:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            wide = data[body] == 1
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
        elif kind == b"stsd":
            track["codec"] = data[body + 12 : body + 16].decode("latin-1")
            track["bits"] = struct.unpack_from(">H", data, body + 34)[0] if body + 36 <= end else 0
        elif kind == b"stts":
            track["times"] = _table(data, body, end, 2)
        elif kind == b"stss":
            track["keys"] = _table(data, body, end, 1)[:, 0] - 1
        elif kind == b"stsc":
            track["chunk_runs"] = _table(data, body, end, 3)
        elif kind == b"stsz":
            one, count = struct.unpack_from(">II", data, body + 4)
            # samples of one size lie in the file, so their number is bounded by its length
            if count * max(one, 1) > len(data) or not one and body + 12 + 4 * count > end:
                raise ValueError("more samples than bytes")
            track["sizes"] = np.full(count, one, dtype=np.int64) if one else np.frombuffer(data, dtype=">u4", count=count, offset=body + 12).astype(np.int64)
        elif kind == b"stz2":
            bits, (count,) = data[body + 7], struct.unpack_from(">I", data, body + 8)
            if bits not in (4, 8, 16) or body + 12 + (count * bits + 7) // 8 > end:
                raise ValueError("bad compact sizes")
            packed = np.frombuffer(data, dtype=np.uint8, count=(count * bits + 7) // 8, offset=body + 12)
            if bits == 4:
                packed = np.stack((packed >> 4, packed & 15), axis=1).ravel()[:count]
            track["sizes"] = packed.view(">u2").astype(np.int64) if bits == 16 else packed.astype(np.int64)
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _table(data, body, end, 1, kind == b"co64")[:, 0]
    for track in tracks:
        sizes, chunks, runs = track.pop("sizes"), track.pop("chunks"), track.pop("chunk_runs")
        steps = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if len(runs) and (runs[0, 0] != 1 or (steps < 0).any()):
            raise ValueError("chunk runs are out of order")
        per_chunk = np.repeat(runs[:, 1], steps)
        if per_chunk.sum() != len(sizes):
            raise ValueError("sample tables disagree")
        first = np.cumsum(per_chunk) - per_chunk
        before = np.concatenate(([0], np.cumsum(sizes)))
        of = np.repeat(np.arange(len(chunks)), per_chunk)
        start = chunks[of] + before[:-1] - before[first][of]
        stop = start + sizes
        if len(stop) and stop.max() > len(data):
            raise ValueError("a sample lies behind the end")
        cut = np.flatnonzero(start[1:] != stop[:-1]) + 1
        track["ranges"] = list(zip(start[np.concatenate(([0], cut))].tolist(), stop[np.concatenate((cut - 1, [len(stop) - 1]))].tolist())) if len(start) else []
        keys = np.arange(len(sizes)) if track["keys"] is None else track["keys"]
        track["key_ranges"] = np.stack((start[keys], stop[keys]), axis=1)
        track["samples"] = len(sizes)
        track["ticks"] = int((track["times"][:, 0] * track["times"][:, 1]).sum())
    return tracks


def feature(track: dict) -> str:
    """Codec, time scale, duration, samples, and key frames with a digest of their byte ranges."""
    keys = track["key_ranges"]
    return f"{track['codec'].strip()}/{track['bits']};{track['timescale']};{track['ticks']};{track['samples']};{len(keys)};" + hashlib.md5(keys.astype(">i8").tobytes()).hexdigest()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, UTF-8, zero padded, as a movie file. Narrow."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([write_media(pad(r)) for r in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features of each stored file: digests of the bytes read back by the table's ranges, codec,
    duration and key-frame byte ranges. Narrow; a file that cannot be parsed gives nulls."""
    schema = (
        f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string, codec string, duration_s double, key_ranges array<struct<start:bigint,end:bigint>>"
    )
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "key_ranges"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9
        whole = hashlib.sha256(data).hexdigest()
        try:
            track = read_media(data)[0]
            payload = b"".join(data[a:b] for a, b in track["ranges"])
        except (ValueError, IndexError, KeyError, struct.error):
            return None, None, None, len(data), whole, None, None, None, None
        keys = [{"start": a, "end": b} for a, b in track["key_ranges"].tolist()]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(data), whole, feature(track), track["codec"], track["ticks"] / max(1, track["timescale"]), keys

    def run(batches):
        for batch in batches:
            found = list(zip(*(one(x.as_py()) for x in batch.column(2)))) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(v), k) for v, k in zip(found, kinds))], names=[id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)

"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at its byte position; an inner node holds the
leftmost minimum of its two halves. The root names the next merge, and a merge updates the leaves of
the live neighbours only, each in logarithmic time. Distinct pieces of one Arrow batch are encoded
together: their trees are rows of one array, and each round performs one merge in every row.

Null or empty text has no tokens. Repeated rows give equal results; only the id and the text column
are read, so other columns never clash. Very long pieces take a scalar tree with the same updates.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: White space as Unicode's White_Space property has it (fixed values).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_INF = np.int64(1) << 62
_POS = 40  # bits for the position below the rank
_CACHE_ENTRIES = 400_000


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; a vocabulary file, so its size is bounded."""
    with open(path, "rb") as f:
        return f.read()


class Tables:
    """Ranks, token bytes and the rank of every mergeable pair."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece; a piece that is itself a token is that token."""
        out: list[list[int] | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif len(piece) > 512:
                out[i] = self._scalar(piece)
            else:
                by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for n, members in by_size.items():
            step = max(1, (1 << 19) // n)
            for at in range(0, len(members), step):
                chosen = members[at : at + step]
                for i, ids in zip(chosen, self._rows([pieces[i] for i in chosen], n)):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _rows(self, pieces: list[bytes], n: int) -> list[list[int]]:
        rows = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, n)
        place = np.arange(n)
        live = place < size[:, None]
        ids = np.full((rows, n + 1), -1, dtype=np.int64)
        ids[:, :n] = np.where(live, self.byte_id[raw], -1)
        nxt = np.minimum(np.broadcast_to(place + 1, (rows, n)), size[:, None]).copy()
        prv = np.broadcast_to(np.arange(-1, n), (rows, n + 1)).copy()
        tree = np.full((rows, 2 * n), _INF, dtype=np.int64)
        rank = self.pair_rank(ids[:, : n - 1], np.maximum(ids[:, 1:n], 0))
        ok = (rank >= 0) & (place[1:] < size[:, None])
        tree[:, n : 2 * n - 1] = np.where(ok, rank << _POS | place[:-1], _INF)
        level = n // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        act = np.flatnonzero(tree[:, 1] < _INF)
        while len(act):
            root = tree[act, 1]
            left = root & ((1 << _POS) - 1)
            right = nxt[act, left]
            after, before = nxt[act, right], prv[act, left]
            merged = root >> _POS
            ids[act, left] = merged
            ids[act, right] = -1
            nxt[act, left] = after
            prv[act, after] = left
            tail = after < size[act]
            rank = self.pair_rank(merged, np.where(tail, ids[act, after], 0))
            at_left = np.where(tail & (rank >= 0), rank << _POS | left, _INF)
            head = before >= 0
            seat = np.maximum(before, 0)
            rank = self.pair_rank(np.where(head, ids[act, seat], 0), merged)
            at_before = np.where(head & (rank >= 0), rank << _POS | seat, _INF)
            tree[act, n + right] = _INF
            tree[act, n + left] = at_left
            tree[act[head], n + before[head]] = at_before[head]
            row = np.concatenate((act, act, act[head]))
            node = np.concatenate((left, right, before[head])) + n
            while node[0] > 1:
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            act = act[tree[act, 1] < _INF]
        kept = ids[:, :n]
        flat, counts = kept[kept >= 0].tolist(), (kept >= 0).sum(axis=1).tolist()
        out, at = [], 0
        for c in counts:
            out.append(flat[at : at + c])
            at += c
        return out

    def _scalar(self, piece: bytes) -> list[int]:
        size = len(piece)
        n = 1 << (size - 1).bit_length()
        ids = [int(self.byte_id[b]) for b in piece]
        nxt, prv = list(range(1, size + 1)), list(range(-1, size + 1))
        inf, mask, get = int(_INF), (1 << _POS) - 1, self.pairs.get
        tree = [inf] * (2 * n)
        for i in range(size - 1):
            if (rank := get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[n + i] = rank << _POS | i
        for i in range(n - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(place: int, value: int) -> None:
            i = place + n
            tree[i] = value
            while i > 1:
                i >>= 1
                new = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == new:
                    break
                tree[i] = new

        while (root := tree[1]) < inf:
            left, merged = root & mask, root >> _POS
            right = nxt[left]
            after, before = nxt[right], prv[left]
            ids[left], ids[right] = merged, -1
            nxt[left] = after
            prv[after] = left
            put(right, inf)
            rank = get(merged << 20 | ids[after]) if after < size else None
            put(left, inf if rank is None else rank << _POS | left)
            if before >= 0:
                rank = get(ids[before] << 20 | merged)
                put(before, inf if rank is None else rank << _POS | before)
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def tables(raw: bytes) -> Tables:
    return Tables(raw)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """``pattern`` compiled with white space as Unicode defines it."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]"))


class Codec:
    """Encodes texts piece by piece; a bounded cache holds the ids of pieces met before."""

    def __init__(self, raw: bytes, pattern: str):
        self.tables, self.find, self.cache = tables(raw), splitter(pattern).findall, {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; pieces not met before are encoded together."""
        split = [self.find(text) for text in texts]
        cache = self.cache
        if len(cache) > _CACHE_ENTRIES:
            cache.clear()
        new = [p for p in set().union(*split) if p not in cache]
        for piece, ids in zip(new, self.tables.encode([p.encode() for p in new])):
            cache[piece] = np.array(ids, dtype=np.int32).tobytes()
        for pieces in split:
            yield np.frombuffer(b"".join(map(cache.__getitem__, pieces)), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tables.tokens.__getitem__, ids))


def groups(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in groups of about ``chars`` characters; nulls become empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return (id, n_tokens, ids, decoded).

    ``ids=False`` leaves the id array and decoded text out; ``digests=True`` adds SHA-256 of both.
    Narrow: no shuffle. ``ranks`` is broadcast once; a vocabulary file bounds its size."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint" + ", ids array<int>, decoded binary" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value, pattern)
        decimal = codec.tables.decimal.__getitem__
        for batch in batches:
            at = 0
            # a record batch a group of texts: ids stay packed and few at a time
            for group in groups(batch.column(1).to_pylist()):
                coded = list(codec.encode(group))
                sizes = np.array([len(c) for c in coded], dtype=np.int64)
                columns, names = [batch.column(0).slice(at, len(group)), pa.array(sizes)], [id_col, "n_tokens"]
                at += len(group)
                whole, marks = [], []
                for got in coded:
                    listed = got.tolist()
                    text = codec.decode(listed)
                    if ids:
                        whole.append(text)
                    if digests:
                        marks.append((hashlib.sha256(" ".join(map(decimal, listed)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded))), pa.array(whole, pa.binary())]
                    names += ["ids", "decoded"]
                if digests:
                    columns += [pa.array([m[i] for m in marks], pa.string()) for i in (0, 1)]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)

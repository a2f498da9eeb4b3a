"""Shuffles by digest, at the cost of one digest a row and draw: rows never multiply by draws as rows.

A draw orders the rows by the first 32 bits of the MD5 of ``seed:draw:id``, then by id, as SQL can. Tasks take the
digests of whole columns at once (an id's message fits one MD5 block, else hashlib does it).

Labels (``labelled_sums``): digests are uniform, so the place of the last label is known up to a narrow window of
digests. Rows below it are summed where they are read; only rows within it are ordered. A draw whose window missed is
read again with all digests as its window.

Values (``dealt_sums``): blocks of equal digest range collect packed columns of all draws. Within a block the draws'
places nearly agree with those of draw 0, and products of equal places are summed there; the rest meets by place."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged, tidied

#: Rows whose digests are taken together, rows of a packed chunk, rows of a block, places of a stretch of leftovers.
LANES, CHUNK, BLOCK, STRETCH = 1 << 14, 1 << 18, 1 << 16, 1 << 16
#: Digests that a task takes, about.
WORK = 1 << 22
#: Half width of the labels' window in standard deviations of the last label's place.
REACH = 8
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_INIT = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def suffix(column: str) -> Column:
    """What follows seed and draw in a row's message; a null leaves no part, as in ``concat_ws``."""
    return F.coalesce(F.concat(F.lit(":"), F.col(column).cast("string")), F.lit(""))


def _first_words(words: list) -> np.ndarray:
    """First word of the MD5 of one-block messages; ``words``: sixteen of them, a number where all rows agree."""
    size = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, x, np.uint32) for x in _INIT)
    t = np.empty(size, np.uint32)
    for i in range(61):  # the last three rounds leave the first word alone
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        if isinstance(words[g], np.ndarray):
            np.add(t, words[g], out=t), np.add(t, np.uint32(_SINE[i]), out=t)
        else:
            np.add(t, np.uint32((_SINE[i] + words[g]) & 0xFFFFFFFF), out=t)
        np.left_shift(t, np.uint32(_TURN[i]), out=a), np.right_shift(t, np.uint32(32 - _TURN[i]), out=t)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(_INIT[0])


class Messages:
    """Suffixes of rows, by length, ready for the digests of many draws."""

    def __init__(self, suffixes: pa.Array):
        suffixes = suffixes.cast(pa.string())
        self.size = len(suffixes)
        ends = np.frombuffer(suffixes.buffers()[1], np.int32)[suffixes.offset : suffixes.offset + self.size + 1].astype(np.int64)
        data = suffixes.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        lengths = np.diff(ends)
        self.groups = []
        for n in np.unique(lengths):
            found = np.flatnonzero(lengths == n)
            for at in range(0, len(found), LANES):
                rows = found[at : at + LANES]
                self.groups.append((rows, data[ends[rows][:, None] + np.arange(n)], {}))

    def digests(self, prefix: bytes) -> np.ndarray:
        """The first 32 bits of MD5 of ``prefix`` and each suffix."""
        out, p = np.empty(self.size, np.uint32), len(prefix)
        for rows, text, ready in self.groups:
            whole = p + text.shape[1]
            if whole > 55 or not text.shape[1]:
                out[rows] = [int.from_bytes(hashlib.md5(prefix + x.tobytes()).digest()[:4], "big") for x in text]
                continue
            if p not in ready:
                block = np.zeros((len(rows), 64), np.uint8)
                block[:, p:whole], block[:, whole] = text, 0x80
                block[:, 56:58] = (8 * whole & 255, 8 * whole >> 8)
                block = block.view("<u4")
                ready[p] = [np.ascontiguousarray(block[:, i]).astype(np.uint32) if p // 4 <= i <= whole // 4 else int(block[0, i]) for i in range(16)]
            words = list(ready[p])
            head = np.frombuffer(prefix + bytes(-p % 4), "<u4")
            for i, x in enumerate(head):
                words[i] = words[i] | np.uint32(x) if isinstance(words[i], np.ndarray) else int(x)
            out[rows] = _first_words(words).byteswap()
        return out


def _prefix(seed: int, b: int) -> bytes:
    return f"{seed}:{b}".encode()


def _tasks(n: int, draws: int) -> int:
    return max(1, -(-n * draws // WORK))


def _buffered(batches, size: int, place: int | None = None):
    """Record batches put together to about ``size`` rows; ``place``: a column without jumps within what is yielded."""
    held, rows = [], 0
    for batch in batches:
        parts = [batch]
        if place is not None and batch.num_rows:
            at = batch.column(place).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), batch.num_rows]
            parts = [batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]
        for part in parts:
            jump = place is not None and held and part.num_rows and part.column(place)[0].as_py() != held[-1].column(place)[-1].as_py() + 1
            if held and (jump or rows + part.num_rows > size):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
            if part.num_rows:
                held.append(part)
                rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    return table.column(i).combine_chunks() if table.column(i).num_chunks != 1 else table.column(i).chunk(0)


@tidied
def labelled_sums(rows: DataFrame, values: list[str], n1: int, n: int, draws: int, seed: int) -> DataFrame:
    """(b, values): sums of the doubles ``values`` over the ``n1`` rows of (id, values) that draw 1 to ``draws`` gives a
    label; ``n``: how many rows there are."""
    kind = rows.schema["id"].dataType.simpleString()
    m = len(values)
    names = ["b", "_h", "id", "_n", *values]
    base = rows.select("id", suffix("id").alias("_s"), *[F.col(v).cast("double").alias(v) for v in values]).repartition(_tasks(n, draws))

    def read(windows: dict[int, tuple[int, int]]) -> DataFrame:
        def run(batches):
            sums = {b: np.zeros(m + 1) for b in windows}
            for table in _buffered(batches, 1 << 16):
                ids, messages = _column(table, 0), Messages(_column(table, 1))
                cells = np.stack([np.ones(table.num_rows), *[table.column(2 + i).to_numpy() for i in range(m)]])
                near, draw = [], []
                for b, (low, high) in windows.items():
                    h = messages.digests(_prefix(seed, b))
                    if low:
                        sums[b] += cells[:, h < low].sum(axis=1)
                    at = np.flatnonzero((h >= low) & (h < high))
                    near.append((at, h[at])), draw.append(np.full(len(at), b, np.int32))
                at, h = (np.concatenate([x[i] for x in near]) for i in (0, 1))
                for i in range(0, len(at), 1 << 16):  # bounded batches
                    some = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(draw)[i : i + (1 << 16)]), pa.array(h[i : i + (1 << 16)].astype(np.int64)), ids.take(pa.array(some)), pa.array(np.ones(len(some), np.int64)), *[pa.array(c[some]) for c in cells[1:]]], names=names)
            total = np.array([sums[b] for b in windows])
            yield pa.RecordBatch.from_arrays([pa.array(list(windows), pa.int32()), pa.array(np.full(len(windows), -1, np.int64)), pa.nulls(len(windows), ids_type(kind)), pa.array(total[:, 0].astype(np.int64)), *[pa.array(total[:, 1 + i]) for i in range(m)]], names=names)

        return staged(base.mapInArrow(run, f"b int, _h bigint, id {kind}, _n bigint, " + ", ".join(f"`{v}` double" for v in values)))

    def counted(met: DataFrame) -> dict[int, tuple[int, int]]:
        """Rows below and within the window of each draw: a row a draw."""
        per = met.groupBy("b").agg(F.sum(F.when(F.col("_h") < 0, F.col("_n")).otherwise(0)).alias("below"), F.count_if(F.col("_h") >= 0).alias("within"))
        return {r["b"]: (r["below"], r["within"]) for r in per.collect()}

    share = n1 / max(n, 1)
    wide = REACH * math.sqrt(share * (1 - share) / max(n, 1)) + 64 / max(n, 1)
    ends = (max(0, int((share - wide) * 2**32)), min(1 << 32, int((share + wide) * 2**32)))
    met = read({b: ends for b in range(1, draws + 1)})
    found = counted(met)
    missed = [b for b, (below, within) in found.items() if not below <= n1 <= below + within]
    if missed:
        whole = read({b: (0, 1 << 32) for b in missed})
        met = met.where(~F.col("b").isin(missed)).unionByName(whole)
    edge = met.where("_h >= 0").withColumn("_k", F.shiftright("_h", 16))
    below = met.where("_h < 0").groupBy("b").agg(F.sum("_n").alias("_below"), *[F.sum(v).alias(v) for v in values])
    counts = edge.groupBy("b", "_k").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("b").orderBy("_k")))
    counts = counts.join(below.select("b", "_below"), "b").withColumn("_upto", F.col("_upto") + F.col("_below"))
    inside = edge.drop("_n").join(counts, ["b", "_k"])
    sure = inside.where(F.col("_upto") <= n1)
    cut = inside.where((F.col("_upto") > n1) & (F.col("_upto") - F.col("_n") < n1))
    cut = cut.withColumn("_o", F.row_number().over(Window.partitionBy("b").orderBy("_h", "id"))).where(F.col("_o") <= n1 - F.col("_upto") + F.col("_n"))
    parts = below.select("b", *values).unionByName(sure.select("b", *values)).unionByName(cut.select("b", *values))
    return parts.groupBy("b").agg(*[F.sum(v).alias(v) for v in values])


def ids_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.get(kind) or to_arrow_type(_parse_datatype_string(kind))


@tidied
def dealt_sums(rows: DataFrame, column: str, others: list[str], n: int, draws: int, seed: int) -> DataFrame:
    """(b, others): for draw 0 (each row keeps its own) to ``draws``, the sums of the products of ``column``, dealt anew by
    the draw, with each of the doubles ``others`` of (id, column, others); ``n``: how many rows there are.
    A row takes the value of the row that had its place in draw 0."""
    m, blocks = len(others), max(1, -(-n // BLOCK))
    ordered = rows.select("id", suffix("id").alias("_s"), F.col(column).cast("double").alias("_x"), *[F.col(c).cast("double").alias(f"_o{i}") for i, c in enumerate(others)]).repartitionByRange(_tasks(n, draws), "id").sortWithinPartitions("id")
    base = staged(ordered.select(F.monotonically_increasing_id().alias("_at"), "_s", "_x", *[f"_o{i}" for i in range(m)]))

    def block_of(h: np.ndarray) -> np.ndarray:
        return (h.astype(np.uint64) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)

    def count(batches):
        seen = np.zeros((draws + 1, blocks), np.int64)
        for table in _buffered(batches, CHUNK):
            messages = Messages(_column(table, 0))
            for b in range(draws + 1):
                seen[b] += np.bincount(block_of(messages.digests(_prefix(seed, b))), minlength=blocks)
        for b in range(draws + 1):
            k = np.flatnonzero(seen[b])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), b, np.int32)), pa.array(seen[b, k])], names=["k", "b", "n"])

    def pack(batches):
        for table in _buffered(batches, CHUNK, 0):
            first = table.column(0)[0].as_py()
            messages = Messages(_column(table, 1))
            x, cells = table.column(2).to_numpy(), [table.column(3 + i).to_numpy() for i in range(m)]
            for b in range(draws + 1):
                h = messages.digests(_prefix(seed, b))
                k = block_of(h)
                order = np.argsort(k, kind="stable") if blocks > 1 else np.arange(len(k))
                ends = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=blocks))])
                held = np.flatnonzero(np.diff(ends))
                packed = [_packed(c[order], ends, held) for c in (h, *cells)]
                own = _packed(x[order], ends, held) if b == 0 else pa.nulls(len(held), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), b, np.int32)), pa.array(np.full(len(held), first, np.int64)), packed[0], own, *packed[1:]], names=["k", "b", "at", "h", "x", *[f"o{i}" for i in range(m)]])

    starts = base.select("_s").mapInArrow(count, "k bigint, b int, n bigint").groupBy("k", "b").agg(F.sum("n").alias("n"))
    starts = starts.select("k", "b", (F.sum("n").over(Window.partitionBy("b").orderBy("k")) - F.col("n")).alias("start"))
    chunks = base.mapInArrow(pack, "k bigint, b int, at bigint, h binary, x binary, " + ", ".join(f"o{i} binary" for i in range(m)))
    sums = ", ".join(f"s{i} double" for i in range(m))
    kind = f"b int, g bigint, own boolean, place bigint, data binary, {sums}"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of products over the places that a draw and draw 0 both have in this block; the others as stretches."""
        start = dict(zip(right.column("b").to_pylist(), right.column("start").to_pylist()))
        rows_of: dict[int, list] = {}
        for i, (b, at) in enumerate(zip(left.column("b").to_pylist(), left.column("at").to_pylist())):
            rows_of.setdefault(b, []).append((at, i))

        def ordered(b: int, columns: list[str]) -> list[np.ndarray]:
            at = [i for _, i in sorted(rows_of.get(b, []))]  # chunks in the order of ids, so places of equal digests are too
            whole = lambda c, t: np.frombuffer(b"".join(left.column(c)[i].as_py() for i in at), t)
            h = whole("h", np.uint32).astype(np.uint64)
            order = (np.sort(h << np.uint64(32) | np.arange(len(h), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return [whole(c, np.float64)[order] for c in columns]

        out: list[tuple] = []
        none = [None] * m

        def leave(b: int, own: bool, place: int, data: np.ndarray) -> None:
            """``data`` (values by place in the last axis), cut at multiples of the stretch."""
            while data.shape[1]:
                g = place // STRETCH
                size = min(data.shape[1], (g + 1) * STRETCH - place)
                out.append((b, g, own, place, np.ascontiguousarray(data[:, :size]).tobytes(), *none))
                place, data = place + size, data[:, size:]

        x = ordered(0, ["x"])[0]
        x0 = start.get(0, 0)
        for b in sorted(start):
            o = np.stack(ordered(b, [f"o{i}" for i in range(m)]))
            s, e = start[b], start[b] + o.shape[1]
            low = max(s, x0)
            high = max(low, min(e, x0 + len(x)))
            if high > low:
                out.append((b, -1, True, -1, None, *(o[:, low - s : high - s] @ x[low - x0 : high - x0]).tolist()))
            else:
                low = high = max(e, x0 + len(x))
            leave(b, False, s, o[:, : max(0, low - s)])
            leave(b, False, max(s, high), o[:, max(0, high - s) :])
        for b in range(1, draws + 1):
            s, e = start.get(b, 0), start.get(b, 0) + sum(left.column("h")[i].as_buffer().size // 4 for _, i in rows_of.get(b, []))
            low = max(s, x0)
            high = max(low, min(e, x0 + len(x)))
            if high == low:
                low = high = x0 + len(x)
            leave(b, True, x0, x[None, : low - x0])
            leave(b, True, high, x[None, high - x0 :])
        return _table(out, m)

    def close(key: tuple, table: pa.Table) -> pa.Table:
        """Sums of a draw's blocks, or of the products over one stretch of places."""
        b, g = (k.as_py() for k in key)
        if g < 0:
            return pa.table([pa.array([b], pa.int32()), *[pa.array([float(table.column(f"s{i}").to_numpy().sum())]) for i in range(m)]], names=["b", *others])
        x, o = np.zeros(STRETCH), np.zeros((m, STRETCH))
        for own, place, data in zip(*(table.column(c).to_pylist() for c in ("own", "place", "data"))):
            at, data = place - g * STRETCH, np.frombuffer(data, np.float64)
            if own:
                x[at : at + len(data)] = data
            else:
                o[:, at : at + len(data) // m] = data.reshape(m, -1)
        return pa.table([pa.array([b], pa.int32()), *[pa.array([v]) for v in (o @ x).tolist()]], names=["b", *others])

    met = chunks.groupBy("k").cogroup(starts.groupBy("k")).applyInArrow(meet, kind)
    ended = met.groupBy("b", "g").applyInArrow(close, "b int, " + ", ".join(f"`{c}` double" for c in others))
    return ended.groupBy("b").agg(*[F.sum(c).alias(c) for c in others])


def _packed(values: np.ndarray, ends: np.ndarray, held: np.ndarray) -> pa.Array:
    """Bytes of the stretches of ``values`` between ``ends`` that hold any."""
    at = np.concatenate([ends[held], ends[-1:]]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _table(rows: list[tuple], m: int) -> pa.Table:
    kinds = [("b", pa.int32()), ("g", pa.int64()), ("own", pa.bool_()), ("place", pa.int64()), ("data", pa.binary()), *[(f"s{i}", pa.float64()) for i in range(m)]]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds)], names=[name for name, _ in kinds])

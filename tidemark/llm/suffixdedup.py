"""Exact removal of repeated byte strings with a sparse suffix array sorted by the deep-shallow method.

Every 400-byte window of a text has an anchor: the leftmost 32-byte gram with the least hash in it. Equal
windows have equal anchors at equal offsets, so it is enough to compare *runs*: the adjacent windows that
share one anchor, and the bytes they span.

1. Runs are grouped by anchor and by content, with counts combined before the shuffle. A run whose content
   occurs twice is repeated as a whole; a run whose anchor has one content only is settled.
2. The suffixes at the anchors of the other runs, and their prefixes read backwards, are sorted per anchor:
   multikey quicksort on 8-byte words to a shallow depth, then a blind trie for each group
   that still shares its prefix. Longest common prefixes to both sides give each run's repeated interval.
3. Anchors with more than ``GROUP`` contents go to no single task. Their runs are cut into aligned slices of
   offsets, keyed by the longer content that all windows of a slice share, and counted again; slices
   of one window are settled by their counts alone.

Repeated passages of few long words or many short ones are told apart by words as well: ``n_passages`` counts the
51-word windows of a text that another document also holds. Windows are anchored by the least of their 16-word
pieces; only windows at anchors that two texts share are compared, by a hash of their words.

Equal texts are one text that occurs twice. Null or empty texts keep their zero bytes. Texts shorter than the
window are kept. Rows are told apart by content only, so null and repeated ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, having, staged
from .neardup import _IS_SPACE, _mix, _powers, runs

WINDOW, GRAM = 400, 32
SPREAD = WINDOW - GRAM + 1
GROUP = 96
SHALLOW = 64
#: Words of a passage, and of the pieces that anchor it.
PASSAGE, PIECE = 51, 16
#: Sizes of the aligned offset slices that crowded anchors are cut into.
SLICES = (96, 24, 6, 1)


class Prefix:
    """Hashes of any range of a text from one pass."""

    def __init__(self, raw: bytes, power: tuple[np.ndarray, np.ndarray]):
        self.up, self.down = power
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(b * self.up[: len(b)])))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def anchored_runs(raw: bytes, power: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, anchor, last window) of each run of a text."""
    n = len(raw)
    of = Prefix(raw, power)
    at = np.arange(n - GRAM + 1)
    gram = of(at, at + GRAM)
    anchor = _window_minima(gram, SPREAD)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
    p = anchor[first]
    content = _mix(of(first, last + WINDOW) + (p - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return gram[p].view(np.int64), content.view(np.int64), first, p, last


def _window_minima(values: np.ndarray, spread: int) -> np.ndarray:
    """Place of the least value (by its upper half, the leftmost of equal ones) in each window of ``spread`` values."""
    least = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values)).astype(np.uint64)
    size = 1
    while 2 * size <= spread:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = spread - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def passage_windows(raw: bytes, power: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """(anchor hash, window hash) of each window of PASSAGE words; null if the text has fewer."""
    space = np.concatenate(([True], _IS_SPACE[np.frombuffer(raw, dtype=np.uint8)], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, stop = edge[0::2], edge[1::2]
    if len(start) < PASSAGE:
        return None
    up, down = power
    word = Prefix(raw, power)(start, stop)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word * up[: len(word)])))
    piece = _mix((sums[PIECE:] - sums[:-PIECE]) * down[: len(word) - PIECE + 1])
    window = _mix((sums[PASSAGE:] - sums[:-PASSAGE]) * down[: len(word) - PASSAGE + 1] + np.uint64(PASSAGE))
    return piece[_window_minima(piece, PASSAGE - PIECE + 1)].view(np.int64), window.view(np.int64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie that stores branching depths and bytes only; the strings are looked at once an insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), {}, [i]]
            return
        # blind descent to some leaf, then one comparison
        node = self.root
        while node[1]:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        leaf = self.strings[node[2][0]]
        same = _common(s, leaf)
        above, node = None, self.root
        equal = same == len(s) == len(leaf)
        while node[1] and node[0] < same + equal:
            above, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        byte = s[same] if same < len(s) else -1
        if equal:
            node[2].append(i)
        elif node[1] and node[0] == same:
            node[1][byte] = [len(s), {}, [i]]
        else:
            split = [same, {byte: [len(s), {}, [i]], (leaf[same] if same < len(leaf) else -1): node}, []]
            if above is None:
                self.root = split
            else:
                above[1][s[above[0]] if above[0] < len(s) else -1] = split

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order."""
        lcp, stack = 0, [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            lcp = before
            if node[1]:
                children = sorted(node[1].items(), reverse=True)
                for place, (_, child) in enumerate(children):
                    stack.append((child, before if place == len(children) - 1 else node[0]))
            else:
                for i in node[2]:
                    yield i, lcp
                    lcp = node[0]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of the strings and each one's common prefix with the one before it (the first: 0)."""
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1:
            order += members
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in members:
                trie.insert(i)
            order += [i for i, _ in trie.ordered()]
        else:
            # ternary split on the next word; an end sorts before any byte
            words = [(strings[i][depth : depth + 8], i) for i in members]
            pivot = words[len(words) // 2][0]
            less, same, more = [i for w, i in words if w < pivot], [i for w, i in words if w == pivot], [i for w, i in words if w > pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) < 8:
                stack += [([i], depth) for i in same]
            else:
                stack.append((same, depth + 8))
            if less:
                stack.append((less, depth))
    return order, [0, *(_common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def _shared(strings: list[bytes]) -> np.ndarray:
    """Common prefix length of every two strings, from the sorted order."""
    order, lcp = deep_shallow(strings)
    n = len(order)
    out = np.zeros((n, n), dtype=np.int64)
    steps = np.array(lcp)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(steps[i + 1 :])
    out += out.T
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return out[np.ix_(place, place)]


def repeated(spans: list[bytes], at: list[int]) -> list[tuple[int, int] | None]:
    """For each run (its bytes, and where in them the anchor is): the repeated interval around the anchor.

    With each other run the two share [anchor - l, anchor + r); all intervals of at least a window's length
    hold the anchor, so their union is one interval."""
    right = _shared([s[p : p + WINDOW] for s, p in zip(spans, at)])
    left = _shared([s[:p][::-1] for s, p in zip(spans, at)])
    good = (left + right >= WINDOW) & ~np.eye(len(spans), dtype=bool)
    l, r, some = np.where(good, left, 0).max(axis=1), np.where(good, right, 0).max(axis=1), good.any(axis=1)
    return [(p - int(a), p + int(b)) if ok else None for p, a, b, ok in zip(at, l, r, some)]


def _emit(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"fp": pa.binary(), "span": pa.binary(), "key": pa.int64(), "cls": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int32())) for c, n in zip(columns, names.split())], names=names.split())


def _find_runs(texts: DataFrame) -> DataFrame:
    def run(batches):
        power = _powers(1 << 16)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            owner: list[bytes] = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                if len(raw) < WINDOW:
                    continue
                if len(raw) >= len(power[0]):
                    power = _powers(2 * len(raw))
                found = anchored_runs(raw, power)
                for part, values in zip(parts, found):
                    part.append(values)
                owner += [hashlib.md5(raw).digest()] * len(found[0])
                if len(owner) > 50_000:
                    yield pack(owner, parts)
                    parts, owner = [[] for _ in range(5)], []
            if owner:
                yield pack(owner, parts)

    def pack(owner, parts):
        key, cls, a, p, b = (np.concatenate(x) for x in parts)
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.binary()), pa.array(key), pa.array(cls), *(pa.array(x.astype(np.int32)) for x in (a, p, b))], names=["fp", "key", "cls", "a", "p", "b"])

    return texts.select("text").mapInArrow(run, "fp binary, key bigint, cls bigint, a int, p int, b int")


def _settle(items: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(repeated runs, open runs with the size m of their anchor's group, staged tables) of distinct runs with a weight n.
    Frequent contents and anchors with many contents meet their rows by broadcast (``having``)."""
    kinds = items.groupBy("key", "cls").agg(F.sum("n").alias("n"), F.min(F.struct("fp", "a", "p", "b")).alias("one"))
    kinds = staged(kinds)
    crowd = staged(kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    often = kinds.where("n > 1").select("key", "cls", F.col("n").alias("times"))
    whole = having(items, often, ["key", "cls"], "times").select("fp", F.col("a").alias("lo"), (F.col("b") + WINDOW).alias("hi"))
    left = having(kinds, crowd, ["key"], "m").select("key", "cls", "m", F.least("n", F.lit(2)).cast("int").alias("n"), "one.*")
    return whole, left, [kinds, crowd]


def _fetch(left: DataFrame, packed: DataFrame) -> DataFrame:
    """Adds each open run's bytes: runs meet their text by its fingerprint, one row a text."""
    per = left.groupBy("fp").agg(F.collect_list(F.struct("key", "cls", "m", "n", "a", "p", "b")).alias("runs")).withColumnRenamed("fp", "_fp")
    met = packed.join(per, F.col("fp") == F.col("_fp")).select("fp", "packed", "runs")

    def run(batches):
        names = "fp key m n a p b span"
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for fp, raw, found in zip(*(batch.column(i) for i in range(3))):
                fp, text = fp.as_py(), unpack(raw.as_py())
                for r in found.as_py():
                    rows.append((fp, r["key"], min(r["m"], 1 << 30), r["n"], r["a"], r["p"], r["b"], text[r["a"] : r["b"] + WINDOW]))
                if len(rows) > 20_000:
                    yield _emit(rows, names)
                    rows = []
            yield _emit(rows, names)

    return met.mapInArrow(run, "fp binary, key bigint, m int, n int, a int, p int, b int, span binary")


def _sorted_groups(items: DataFrame) -> DataFrame:
    def run(batches):
        rows = []
        for group in runs(batches, "key"):
            seen = {}
            for i, k in enumerate(zip(group.column("fp").to_pylist(), group.column("a").to_pylist(), group.column("b").to_pylist())):
                seen.setdefault(k, i)
            fp, a, p, n, span = (group.column(c).to_pylist() for c in ("fp", "a", "p", "n", "span"))
            chosen = list(seen.values())
            for i, cover in zip(chosen, repeated([span[i] for i in chosen], [p[i] - a[i] for i in chosen])):
                if cover and n[i] == 1:
                    rows.append((fp[i], a[i] + cover[0], a[i] + cover[1]))
            if len(rows) > 20_000:
                yield _emit(rows, "fp lo hi")
                rows = []
        yield _emit(rows, "fp lo hi")

    return items.select("key", "fp", "a", "p", "b", "n", "span").repartition("key").sortWithinPartitions("key").mapInArrow(run, "fp binary, lo int, hi int")


def _sliced(items: DataFrame, size: int) -> DataFrame:
    """Cut runs into aligned slices of ``size`` offsets, keyed by the bytes that all windows of a slice share."""

    def run(batches):
        power = _powers(4 * WINDOW)
        names = "fp key cls n a p b span"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                of, a, p, b = Prefix(r["span"], power), r["a"], r["p"], r["b"]
                for s in range((p - b) // size, (p - a) // size + 1):
                    # offsets before the anchor from s * size to s * size + size - 1
                    lo, hi = max(a, p - s * size - size + 1), min(b, p - s * size)
                    core = p - s * size, p - s * size - size + 1 + WINDOW
                    start, stop = np.array([core[0] - a, lo - a]), np.array([core[1] - a, hi + WINDOW - a])
                    key, cls = of(start, stop).tolist()
                    mark = np.array([key ^ (s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), cls ^ ((p - lo) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)], dtype=np.uint64)
                    mark[0] ^= np.uint64(r["key"] & 0xFFFFFFFFFFFFFFFF)
                    key, cls = _mix(mark).view(np.int64).tolist()
                    rows.append((r["fp"], key, cls, r["n"], lo, p, hi, r["span"][lo - a : hi + WINDOW - a]))
                if len(rows) > 20_000:
                    yield _emit(rows, names)
                    rows = []
            yield _emit(rows, names)

    return items.select("fp", "key", "n", "a", "p", "b", "span").mapInArrow(run, "fp binary, key bigint, cls bigint, n int, a int, p int, b int, span binary")


def repeated_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """((fp, lo, hi), staged tables to discard once that is written): repeated intervals of each distinct text; fp is the
    md5 of its bytes. Intervals overlap."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = staged(_find_runs(texts).distinct().withColumn("n", F.lit(1)))
    whole, left, kinds = _settle(items)

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [t.encode() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()), pa.array([squeeze(r) for r in raw], pa.binary())], names=["fp", "packed"])

    packed = texts.where(F.octet_length("text") >= WINDOW).mapInArrow(pack, "fp binary, packed binary")
    # one row a text: equal texts combine before the shuffle
    packed = packed.groupBy("fp").agg(F.first("packed").alias("packed"))
    found = staged(_fetch(left, packed))
    spent = [items, *kinds, found]
    covers = [whole, _sorted_groups(found.where(F.col("m") <= GROUP))]
    crowded = found.where(F.col("m") > GROUP)
    for size in SLICES:
        if crowded.isEmpty():
            break
        cut = staged(_sliced(crowded, size))
        kinds = staged(cut.groupBy("key", "cls").agg(F.sum("n").alias("w")))
        crowd = staged(kinds.groupBy("key").agg(F.count("*").cast("int").alias("m")).where("m > 1"))
        covers.append(having(cut.where("n = 1"), kinds.where("w > 1"), ["key", "cls"], "w").select("fp", F.col("a").alias("lo"), (F.col("b") + WINDOW).alias("hi")))
        one = cut.groupBy("key", "cls").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("fp", "a", "p", "b", "span")).alias("one")).select("key", "cls", "n", "one.*")
        one = staged(one)
        found = staged(having(one, crowd, ["key"], "m"))
        spent += [cut, kinds, crowd, one, found]
        covers.append(_sorted_groups(found.where(F.col("m") <= GROUP)))
        crowded = found.where(F.col("m") > GROUP)
    out = covers[0]
    for more in covers[1:]:
        out = out.union(more)
    return out, spent


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def fingerprint(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8")))


def shared_anchors(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((f, anchors), staged tables to discard): the anchors of each text's passages that another row has too; f is the first
    half of the text's fingerprint. Two texts with one f get both lists, which only makes more windows meet."""

    def run(batches):
        power = _powers(1 << 16)
        for batch in batches:
            owner, found = [], []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                if len(raw) >= len(power[0]):
                    power = _powers(2 * len(raw))
                windows = passage_windows(raw, power)
                if windows:
                    anchors = np.unique(windows[0])
                    found.append(anchors)
                    owner += [half(hashlib.md5(raw).digest())] * len(anchors)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], names=["f", "anchor"])

    pairs = staged(texts.select("text").mapInArrow(run, "f bigint, anchor bigint"))
    often = staged(pairs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    return having(pairs, often, ["anchor"], "n").groupBy("f").agg(F.collect_set("anchor").alias("anchors")), [pairs, often]


def half(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "big", signed=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, passages: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept][, n_passages]) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    covers, spent = repeated_spans(docs, text_col)
    spans = covers.groupBy("fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    twice = rows.where(F.length("text") > 0).groupBy("fp").agg(F.count("*").alias("copies")).where("copies > 1")
    f = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("bigint")
    info = staged(spans.join(twice, "fp", "full").groupBy(f.alias("f")).agg(F.collect_list(F.struct("fp", "spans", "copies")).alias("of")))
    discard(*spent)
    if passages:
        anchors, pairs = shared_anchors(rows)
        both = staged(info.join(anchors, "f", "full"))
        discard(info, *pairs)
        info = both
    else:
        info = info.withColumn("anchors", F.lit(None).cast("array<bigint>"))

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([pack(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "fp", "packed"])

    # empty texts have no fingerprint, so that they do not meet; of equal texts a hot one's key is split by adaptive execution
    met = rows.withColumn("fp", F.when(F.length("text") > 0, F.col("fp"))).mapInArrow(squeeze, f"id {kind}, fp binary, packed binary")
    # an empty text's key is its id's hash: whatever entry it may meet has another fingerprint
    met = met.withColumn("_key", F.coalesce(f, F.xxhash64("id"))).join(info.withColumnRenamed("f", "_f"), F.col("_key") == F.col("_f"), "left").select("id", "packed", "of", "fp", "anchors")
    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept", "fp", "windows", "alone"]
    chosen = names[: 6 if keep_bytes else 5] + ["fp", "windows", "alone"] * passages

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        power = _powers(1 << 16)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for packed, of, fp, anchors in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                raw = unpack(packed.as_py())
                mine = next((x for x in of.as_py() or [] if x["fp"] == fp), {"spans": None, "copies": None})
                copies = mine["copies"]
                gone = [(0, len(raw))] if copies and len(raw) >= WINDOW else merged([(s["lo"], s["hi"]) for s in mine["spans"] or []])
                ends = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[0::2], ends[1::2]))
                windows, alone = None, 0
                if passages and (anchors.is_valid or copies):
                    if len(raw) >= len(power[0]):
                        power = _powers(2 * len(raw))
                    seen = passage_windows(raw, power)
                    if seen and copies:
                        alone = len(seen[0])
                    if seen and anchors.is_valid:
                        windows = seen[1][np.isin(seen[0], np.array(anchors.as_py(), dtype=np.int64))]
                values = (len(raw), len(raw) - len(kept), len(gone), [{"lo": a, "hi": b} for a, b in gone], hashlib.sha256(kept).hexdigest(), kept, half(fp) if fp else None, windows, alone)
                for name, value in zip(names, values):
                    out[name].append(value)
            kinds = dict(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], kinds[n]) for n in chosen)], names=[id_col, *chosen])

    types = dict(zip(names, ["bigint", "bigint", "bigint", "array<struct<lo:int,hi:int>>", "string", "binary", "bigint", "array<bigint>", "bigint"]))
    done = met.mapInArrow(cut, f"`{id_col}` {kind}, " + ", ".join(f"{n} {types[n]}" for n in chosen))
    if not passages:
        return done
    done = staged(done.withColumn("rid", F.monotonically_increasing_id()))
    discard(info)
    # from here on fp is the first half of the fingerprint: texts that share it count as one, with a chance of 2^-64 a pair
    # windows of a text count once; a text with copies is repeated as a whole
    held = done.where(F.size("windows") > 0).select("rid", "fp", "alone", F.explode("windows").alias("w"))
    shared = staged(held.select("fp", "w").distinct().groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    counts = having(held.where("alone = 0"), shared, ["w"], "n").groupBy("rid").agg(F.count("*").alias("n")).withColumnRenamed("rid", "_r")
    return done.join(counts, F.col("rid") == F.col("_r"), "left").withColumn("n_passages", F.greatest("alone", F.coalesce("n", F.lit(0).cast("bigint")))).drop("rid", "_r", "n", "fp", "windows", "alone")

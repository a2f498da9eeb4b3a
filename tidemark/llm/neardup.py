"""Near-duplicate documents: MinHash, banding, signature verification, exact links, components.

1. Each text becomes a set of word-shingle hashes (64 bits), its MinHash signature (128 universal
   hash minima; a byte of each is stored) and band keys: 26 of 5 minima at a threshold of 0.85. Texts with equal sets form a class.
2. In each band bucket with two or more classes, signatures are compared and a spanning forest of the pairs
   that could reach the threshold (5 standard deviations below it) goes on. Components
   of these forests are clusters: no link crosses them.
3. In each cluster, intersections of whole sets are counted with posting lists, and the links at or
   above the threshold leave as a spanning forest. Their components are the result.

A pair at the threshold shares no bucket with a probability below 1e-6. Buckets and clusters above a block's size are
dealt as pairs of blocks, so no task holds a group and no pair leaves a task but forest edges.

Null, empty or blank texts have empty sets and are linked with nothing. A text with fewer words than a
shingle is one shingle. Rows that share an id, or have none, are separate rows: they are told apart by their place
in the table, and a null id sorts last in its group. An empty table gives no rows. Only id and text are read, so other
columns may have any name; a component's id is the smallest id in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_rows, keyed, own_columns, staged
from .components import connected

HASHES = 130
SIGNATURE = 128
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 128
_M = np.random.default_rng(20240229).integers(1, 1 << 63, size=HASHES + 8, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles, A-Z folded."""
    raw = [b" " + t.encode() + b" " if t else b" " for t in texts]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    space = _IS_SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    up, down = _powers(len(flat) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((_FOLD[flat].astype(np.uint64) + np.uint64(1)) * up[:-1])))
    word = _mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _M[0])
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    padded = np.concatenate((word, np.zeros(width, dtype=np.uint64)))
    shingle = np.zeros(len(word), dtype=np.uint64)
    for i in range(width):
        shingle = _mix(shingle * _M[1] + padded[i : i + len(word)] + np.uint64(i))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(shingle[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), seed=b - a)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of HASHES multiply-shift functions over a non-empty set (32 bits each)."""
    out = np.empty(HASHES, dtype=np.uint32)
    step = max(1, (1 << 17) // len(hashes))
    for i in range(0, HASHES, step):
        out[i : i + step] = ((hashes[None, :] * _M[8 + i : 8 + i + step, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1)
    return out


def banding(threshold: float, miss: float = 1e-6) -> int:
    """The most minima a band may hold for a pair at the threshold to be missed less often than ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (HASHES // (rows + 1)) < miss:
        rows += 1
    return rows


def band_keys(minima: np.ndarray, per_band: int) -> np.ndarray:
    bands = HASHES // per_band
    rows = minima[: bands * per_band].reshape(bands, per_band).astype(np.uint64)
    key = np.zeros(bands, dtype=np.uint64)
    for i in range(per_band):
        key = _mix(key * _M[2] + rows[:, i])
    return key.astype(np.int64)


def _chunks(values: list, chars: int = 1 << 21) -> Iterator[list]:
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v or "") + 16
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of adjacent rows with one key, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest edges; ``near(i, others)`` says which of ``others`` are linked with i. Only rows
    not reached yet are compared, so a dense group costs little more than its size."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, key: str) -> DataFrame:
    """(uid, id, k, n, fp, sig, bands) of each row; fp identifies the set, null if it is empty; k is the column ``key``."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(key).alias("k"), F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    per_band = banding(threshold)

    def run(batches):
        for batch in batches:
            n, fp, sig, bands = [], [], [], []
            for chunk in _chunks(batch.column("_text").to_pylist()):
                for s in shingle_sets(chunk, width):
                    n.append(len(s))
                    if not len(s):
                        fp.append(None), sig.append(None), bands.append(None)
                        continue
                    minima = signature(s)
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append((minima[:SIGNATURE] & 255).astype(np.uint8).tobytes())
                    bands.append(band_keys(minima, per_band))
            kept = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[*kept, "n", "fp", "sig", "bands"])

    return rows.mapInArrow(run, f"{kinds}, n bigint, fp binary, sig binary, bands array<bigint>")


def _blocks(rows: DataFrame, keys: list[str], node: str, block: int) -> DataFrame:
    """Deal each group of ``keys`` as pairs of hashed blocks; ``m`` is the group's size. One row a pair."""
    n = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64(node), n).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("_b", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # a group of several blocks needs no block by itself: its pairs with others cover it
    dealt = dealt.where((F.col("_n") == 1) | (F.col("_j") != F.col("_b")))
    return dealt.withColumn("g", F.xxhash64(*keys, F.least("_b", "_j"), F.greatest("_b", "_j"))).drop("_n", "_b", "_j")


def clusters(classes: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """((node, cluster, m), staged tables to discard after use): components of signature forests over band buckets; m is the cluster's size."""
    spread = 5.2 * (threshold * (1 - threshold) / SIGNATURE) ** 0.5
    least = int(max(1, np.floor((threshold + (1 - threshold) / 256 - spread) * SIGNATURE)))
    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    full = rows.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("band").alias("_b"), F.col("key").alias("_k"), "m")
    shared = staged(rows.join(full, (F.col("band") == F.col("_b")) & (F.col("key") == F.col("_k"))).select("node", "band", "key", "m"))
    signed = shared.join(classes.select(F.col("node").alias("_node"), "sig"), F.col("node") == F.col("_node")).drop("_node")
    dealt = _blocks(signed, ["band", "key"], "node", BUCKET_BLOCK).select("g", "node", "sig")

    def run(batches):
        a, b = [], []
        for group in runs(batches, "g"):
            node = group.column("node").to_numpy()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            for i, j in forest(len(node), lambda i, rest: (sig[rest] == sig[i]).sum(axis=1) >= least):
                a.append(node[i])
                b.append(node[j])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    edges = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")
    found = staged(connected(edges))
    discard(shared)
    sizes = found.groupBy("root").agg(F.count("*").alias("m")).select(F.col("root").alias("_r"), "m")
    return found.join(sizes, F.col("root") == F.col("_r")).select("node", F.col("root").alias("cluster"), "m"), [found]


def links(members: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b): a spanning forest, per pair of blocks of a cluster, of the pairs whose sets reach the threshold.

    ``members``: (node, k, fp, cluster, m). Sets are made again from ``texts`` (_k, _text), found by the row's key."""
    joined = _blocks(members.join(texts, F.col("k") == F.col("_k")).select("node", "fp", "cluster", "m", "_text").transform(lambda d: _sets(d, width)), ["cluster"], "node", CLUSTER_BLOCK).select("g", "node", "hashes")
    top, whole = round(threshold * 100), 100

    def run(batches):
        a, b = [], []
        for group in runs(batches, "g"):
            node, first = np.unique(group.column("node").to_numpy(), return_index=True)
            raw = group.column("hashes").to_pylist()
            sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in first]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), size)
            # posting lists: owners of each distinct hash, side by side
            order = np.argsort(flat, kind="stable")
            rank = np.empty(len(flat), dtype=np.int64)
            new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
            rank[order] = np.cumsum(new) - 1
            begin = np.append(np.flatnonzero(new), len(flat))
            posted = owner[order]
            at = np.concatenate(([0], np.cumsum(size)))

            def near(i, rest):
                mine = rank[at[i] : at[i + 1]]
                lengths = begin[mine + 1] - begin[mine]
                ends = np.cumsum(lengths)
                take = np.arange(ends[-1]) + np.repeat(begin[mine] - ends + lengths, lengths)
                both = np.bincount(posted[take], minlength=len(sets))[rest]
                return whole * both >= top * (size[i] + size[rest] - both)

            for i, j in forest(len(sets), near):
                a.append(node[i])
                b.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return joined.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            text, fp = batch.column("_text").to_pylist(), batch.column("fp").to_pylist()
            made = [s for chunk in _chunks(text) for s in shingle_sets(chunk, width)]
            raw = [s.tobytes() for s in made]
            same = pa.array([xxhash.xxh3_128_digest(r) == f for r, f in zip(raw, fp)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("cluster"), batch.column("m"), pa.array(raw, pa.binary())], names=["node", "cluster", "m", "hashes"])
            yield out.filter(same)

    return rows.mapInArrow(run, "node bigint, cluster bigint, m bigint, hashes binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: float = 0.85, key: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept, first) of each row, and ``k``, its key. ``kept``: the id is its component's;
    ``first``: the one row of the component that stays when rows share ids. ``key``: a column that names rows, if there is one.

    Texts cross a shuffle once, to those that may be linked; all else moves ids, signatures and figures."""
    if abs(100 * threshold - round(100 * threshold)) > 1e-9:
        raise ValueError("the threshold is a whole percentage")
    if key is None:
        docs, key = keyed(docs)
    rows = staged(sketched(docs, id_col, text_col, width, threshold, key))
    # the sets of a class are equal, so any row's signature is the class's; hot classes combine map-side
    low = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid"), F.col("k").alias("k"))
    classes = staged(rows.where("fp is not null").groupBy("fp").agg(F.min(low).alias("low"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("node", F.col("low.uid")))
    cluster, spent = clusters(classes, threshold)
    members = cluster.join(classes.select(F.col("node").alias("_node"), "fp", F.col("low.k").alias("k")), F.col("node") == F.col("_node")).drop("_node")
    texts = docs.select(F.col(key).alias("_k"), F.col(text_col).alias("_text"))
    roots = staged(connected(links(members, texts, width, threshold)))
    placed = classes.select("fp", "low", "node").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    placed = staged(placed.select("fp", "low", F.coalesce("root", "node").alias("root")))
    discard(classes, roots, *spent)
    lowest = placed.groupBy("root").agg(F.min("low").alias("least")).withColumnRenamed("root", "_root")
    least = staged(placed.join(lowest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "least"))
    discard(placed)
    # empty sets have keys of their own, so that they don't meet in one task
    own = F.coalesce(F.col("fp"), F.col("uid").cast("string").cast("binary"))
    out = rows.drop("sig", "bands").withColumn("_key", own).join(least, F.col("_key") == F.col("_fp"), "left")
    component = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("least.uid") == F.col("uid"), F.lit(True)).alias("first"), "k")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each component, all columns as they were: the one with the smallest id, the earlier one of equal ids.

    What comes back to the texts is the keys of the rows that go, as an anti-join (broadcast only below a checked size)."""
    rows, key = keyed(docs)
    found = near_duplicates(rows, id_col, text_col, width, threshold, key)
    return keep_rows(rows, key, staged(found.where(~F.col("first")).select("k"))).select(*own_columns(docs))

"""Importance resampling towards a target: hashed features, array-scored weights, and exact selection of the highest scores.

A feature is a run of one to ``runs`` consecutive words; it falls in the bucket of its CRC-32. One scan of each table
counts buckets, a gain a bucket says how much more the target has of it, and a second scan scores every document by an
array of gains: the floored mean of its features' gains, plus Gumbel noise from a digest of its id.

The highest scores are found by weighted median-of-medians selection: each round, every chunk of remaining keys gives its
median, weighted by the chunk's remaining size; the weighted median of those has a fixed fraction of the keys on
either side, and the side without the cutoff is discarded. Rounds go on until at most ``FINISH`` keys are left. Only the
winners are sorted, by range partitions whose sizes give the ranks.

A null or empty text has no features: n_features 0, weight 0, never eligible. A null id is hashed as an empty string and
is after all others among equal scores. Rows that share an id are documents of their own. Equal keys go by
their row in the scored table. Empty tables give no rows; without a target every count of it is 0. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, word_table

#: ASCII letters and digits; together with all bytes beyond ASCII they make words.
WORDS = word_table(b"0123456789")
#: Distinct features that a task remembers.
HELD = 1 << 20
#: Keys of a chunk that gives one median, and keys that the driver orders at the end.
CHUNK, FINISH = 1 << 20, 4096
LAST = (1 << 63) - 1


def _features(text: bytes, runs: int) -> tuple[list[bytes], int]:
    """(features, words) of a text."""
    words = text.translate(WORDS).split()
    found = words if runs == 1 else words + [b" ".join(words[i : i + k]) for k in range(2, runs + 1) for i in range(len(words) - k + 1)]
    return found, len(words)


def bucket_counts(texts: DataFrame, runs: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        total, seen = np.zeros(buckets, dtype=np.int64), Counter()

        def drain():
            at = np.fromiter((zlib.crc32(f) % buckets for f in seen), dtype=np.int64, count=len(seen))
            np.add.at(total, at, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
            seen.clear()

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(_features(t, runs)[0])
                if len(seen) > HELD:
                    drain()
        drain()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])

    read = texts.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    out = np.zeros(buckets, dtype=np.int64)
    for row in read.mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[row["k"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the target's smoothed share of each bucket over the source's."""
    n = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source, target)]


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], runs: int, seed: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, words) of every document."""
    buckets = len(gain)

    class Gains(dict):
        def __missing__(self, feature):
            if len(self) > HELD:
                self.clear()
            value = self[feature] = gain[zlib.crc32(feature) % buckets]
            return value

    def run(batches):
        of = Gains()
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found, words = _features(t, runs)
                weight = sum(map(of.__getitem__, found)) // max(1, len(found))
                out.append((i, len(found), weight, weight + noise(seed, i), words))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], names=["doc_id", "n_features", "weight", "score", "words"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint, score bigint, words bigint")


def _upto(a: np.ndarray, b: np.ndarray, c: np.ndarray, key: tuple) -> np.ndarray:
    x, y, z = key
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))


def _above(key: tuple):
    a, b, c = (F.lit(x) for x in key)
    return (F.col("a") > a) | ((F.col("a") == a) & ((F.col("b") > b) | ((F.col("b") == b) & (F.col("c") > c))))


def _medians(keys: DataFrame, pivot: tuple | None, chunk: int) -> dict[bool, list[tuple[int, tuple]]]:
    """By side of ``pivot`` (True: above it), the size and the median key of every chunk of ``keys``."""

    def run(batches):
        def rows(parts):
            a, b, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            low = np.zeros(len(a), dtype=bool) if pivot is None else _upto(a, b, c, pivot)
            out = []
            for side in (False, True):
                at = np.flatnonzero(low != side)
                if len(at):
                    m = at[np.lexsort((c[at], b[at], a[at]))[(len(at) - 1) // 2]]
                    out.append((side, len(at), int(a[m]), int(b[m]), int(c[m])))
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema(list(zip(names, (pa.bool_(), *[pa.int64()] * 4)))))

        names, parts, held = ("above", "n", "a", "b", "c"), [], 0
        for batch in batches:
            parts.append([x.to_numpy() for x in batch.columns])
            held += batch.num_rows
            if held >= chunk:
                yield rows(parts)
                parts, held = [], 0
        if held:
            yield rows(parts)

    out = {False: [], True: []}
    for r in keys.select("a", "b", "c").mapInArrow(run, "above boolean, n bigint, a bigint, b bigint, c bigint").collect():  # two rows a chunk
        out[r["above"]].append((r["n"], (r["a"], r["b"], r["c"])))
    return out


def smallest_key(keys: DataFrame, k: int, chunk: int = CHUNK, finish: int = FINISH) -> tuple:
    """The ``k``-th smallest of the distinct keys (a, b, c: bigint) of a staged table of at least ``k`` rows."""
    left, before, written, own = keys, 0, None, None
    sides = _medians(left, None, chunk)[True]
    while (n := sum(size for size, _ in sides)) > finish:
        if written is None:
            written = n
        middle, pivot = 0, None
        for size, pivot in sorted(sides, key=lambda x: x[1]):
            middle += size
            if 2 * middle >= n:
                break
        halves = _medians(left, pivot, chunk)
        low = sum(size for size, _ in halves[False])
        if before + low >= k:
            left, sides = left.where(~_above(pivot)), halves[False]
        else:
            left, sides, before = left.where(_above(pivot)), halves[True], before + low
        rest = sum(size for size, _ in sides)
        if finish < rest <= written // 8:  # what is left is written once it is an eighth
            left, old, written = staged(left), own, rest
            own = left
            if old is not None:
                discard(old)
    last = sorted((r["a"], r["b"], r["c"]) for r in left.select("a", "b", "c").collect())  # at most ``finish`` keys
    if own is not None:
        discard(own)
    return last[k - before - 1]


def ranked(winners: DataFrame, by: list[str]) -> DataFrame:
    """``winners`` with their rank from 1 in the order of ``by``: a range partition each, and the sizes of those before it."""
    place = staged(winners.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # a row a partition, in one task
    sizes = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return place.join(F.broadcast(sizes.drop("_n")), part == F.col("_part")).withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, text: str = "text", id_col: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the documents of ``least_words`` or more, the ``percent`` of highest score
    have ranks from 1; the others have none."""
    gain = gains(bucket_counts(docs, runs, buckets, text), bucket_counts(target, runs, buckets, target_text))
    rows = staged(scored(docs, gain, runs, seed, text, id_col).withColumn("c", F.monotonically_increasing_id()))
    keys = rows.where(F.col("words") >= least_words).select((-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(LAST)).alias("b"), "c")
    k = keys.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return rows.select(*columns, none)
    cut = smallest_key(keys, k)
    keyed = rows.withColumn("a", -F.col("score")).withColumn("b", F.coalesce("doc_id", F.lit(LAST)))
    drawn = (F.col("words") >= least_words) & ~_above(cut)
    return ranked(keyed.where(drawn), ["a", "b", "c"]).select(*columns, "rank").unionByName(keyed.where(~drawn).select(*columns, none))

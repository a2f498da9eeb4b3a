"""Permutation tests whose draws cost counts, not rows.

A shuffle only matters through which places of the ordered values get a label. Labels are split down a binary tree of
places by hypergeometric draws, along the way to the middle places of either group, so a draw costs the depth of the
tree. Values meet the drawn places afterwards."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

#: Draws that one row of a dealt table stands for.
BLOCK = 1000


def middle_places(rng: np.random.Generator, n: int, n1: int, draws: int) -> np.ndarray:
    """(draws, 4): the two middle places, from 0, of ``n1`` labelled rows among ``n``, and of the others (equal ones where a
    group is odd)."""
    n2 = n - n1
    rank = np.tile(np.array([(n1 - 1) // 2, n1 // 2, (n2 - 1) // 2, n2 // 2]), (draws, 1))
    low, size, k = np.zeros((draws, 4), np.int64), np.full((draws, 4), n, np.int64), np.full((draws, 4), n1, np.int64)
    while (size > 1).any():
        half = size // 2
        left = np.empty_like(k)
        for t in range(4):
            left[:, t] = rng.hypergeometric(k[:, t], size[:, t] - k[:, t], half[:, t])
            for earlier in range(t):  # searches that are still in one node see one split of it
                same = low[:, t] == low[:, earlier]
                left[same, t] = left[same, earlier]
        found = np.where(np.arange(4) < 2, left, half - left)
        right = rank >= found
        rank = np.where(right, rank - found, rank)
        low = np.where(right, low + half, low)
        k = np.where(right, k - left, left)
        size = np.where(right, size - half, half)
    return low


def placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, place): rows numbered from 0 in the order of ``value`` within their keys. Staged; no task holds a key."""
    spread = [*keys, value]
    at = staged(rows.select(*spread).repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return staged(at.withColumn("_part", part).join(sizes.drop("_n"), [*keys, "_part"]).select(*spread, (F.col("_before") + F.col("_at") - F.col("_first")).alias("place")))


def _dealt(sizes: DataFrame, draws: int) -> DataFrame:
    """``sizes`` once for each block of draws."""
    return sizes.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BLOCK)))).repartition("_block", *[c for c in sizes.columns if c not in ("n1", "n2")])


def _rng(seed: int, key: tuple, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), block])


def _two_sided(reps: DataFrame, est: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """p of each key: draws at least as far out as the estimate, itself among them; rounding does not break ties."""
    met = reps.join(est.select(*keys, "est"), keys)
    far = F.abs("d") >= F.abs("est") - 1e-12 * F.greatest(F.lit(1.0), F.abs("est"))
    return met.groupBy(*keys).agg(((F.count_if(far) + 1) / F.lit(draws + 1)).alias("p"))


def median_tests(rows: DataFrame, keys: list[str], value: str, flag: str, draws: int, seed: int = 0) -> DataFrame:
    """(keys, n1, n2, est, p): difference of medians between flagged rows and the rest, for every key; null values go.
    est and p are null below three rows a side, p too if ``draws`` is 0. A key may have up to a billion rows."""
    r = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(flag).alias("_one"))
    r = staged(r)
    side = lambda c: F.percentile(F.when(c, F.col("_v")), F.lit(0.5))
    est = r.groupBy(*keys).agg(F.count_if("_one").alias("n1"), F.count_if(~F.col("_one")).alias("n2"), (side(F.col("_one")) - side(~F.col("_one"))).alias("est"))
    est = staged(est.withColumn("est", F.when(F.least("n1", "n2") >= 3, F.col("est"))))
    if not draws:
        return est.withColumn("p", F.lit(None).cast("double"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in est.select(*keys).schema.fields)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                n = min(BLOCK, draws - r["_block"] * BLOCK)
                at = middle_places(_rng(seed, key, r["_block"]), r["n1"] + r["n2"], r["n1"], n)
                b = np.repeat(np.arange(n) + r["_block"] * BLOCK, 4)
                columns = [pa.array([k] * (4 * n), batch.schema.field(name).type) for k, name in zip(key, keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(b, pa.int64()), pa.array(np.tile([True, True, False, False], n)), pa.array(at.ravel(), pa.int64())], names=[*keys, "b", "_side", "place"])

    places = _dealt(est.where("est is not null").select(*keys, "n1", "n2"), draws).mapInArrow(run, f"{kinds}, b bigint, _side boolean, place bigint")
    values = places.join(placed(r, keys, "_v"), [*keys, "place"])
    mid = lambda c: F.avg(F.when(c, F.col("_v")))
    reps = values.groupBy(*keys, "b").agg((mid(F.col("_side")) - mid(~F.col("_side"))).alias("d"))
    return est.join(_two_sided(reps, est, keys, draws), keys, "left")


def rate_tests(rows: DataFrame, keys: list[str], value: str, flag: str, draws: int, seed: int = 0) -> DataFrame:
    """(keys, n1, n2, est, p): difference of the shares of rows with a true ``value``; one hypergeometric number a draw."""
    r = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    one, yes = F.col(flag), F.col(value)
    est = r.groupBy(*keys).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"), F.count_if(yes).alias("_yes"), (F.avg(F.when(one, yes.cast("int"))) - F.avg(F.when(~one, yes.cast("int")))).alias("est"))
    est = staged(est.withColumn("est", F.when(F.least("n1", "n2") >= 3, F.col("est"))))
    if not draws:
        return est.drop("_yes").withColumn("p", F.lit(None).cast("double"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in est.select(*keys).schema.fields)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                n = min(BLOCK, draws - r["_block"] * BLOCK)
                hits = _rng(seed, key, r["_block"]).hypergeometric(r["_yes"], r["n1"] + r["n2"] - r["_yes"], r["n1"], size=n)
                d = hits / r["n1"] - (r["_yes"] - hits) / r["n2"]
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * n, batch.schema.field(name).type) for k, name in zip(key, keys)], pa.array(d)], names=[*keys, "d"])

    reps = _dealt(est.where("est is not null").select(*keys, "_yes", "n1", "n2"), draws).mapInArrow(run, f"{kinds}, d double")
    return est.drop("_yes").join(_two_sided(reps, est, keys, draws), keys, "left")

"""Data-quality checks: sides, coverage, gaps, duplicates, dropped and reinstated rows, equality, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..params import DAY, MINUTE
from ..storage import staged

LONG_CLOSES = ("Close Long", "Liquidated Cross Long", "Liquidated Isolated Long")


def side_check(fills: DataFrame) -> DataFrame:
    """Rows per symbol that contradict side and direction; all ``bad_`` counts are 0 on sound data."""
    sell, buy, d = F.col("side") == "sell", F.col("side") == "buy", F.col("direction")
    return fills.groupBy("symbol").agg(
        F.count_if(~F.coalesce(sell | buy, F.lit(False))).alias("bad_side"),
        F.count_if(sell & ~F.coalesce(d.isin(*LONG_CLOSES), F.lit(False))).alias("bad_sell"),
        F.count_if(buy & ~F.coalesce(d.contains("Short"), F.lit(False))).alias("bad_buy"),
        F.count_if(sell).alias("sell_rows"), F.count_if(buy).alias("buy_rows"),
    )


def permissive_sells(fills: DataFrame) -> DataFrame:
    """Sides spelt sell, a or ask; only where a symbol has none of them, directions with 'long'."""
    plain = F.coalesce(F.lower("side").isin("sell", "a", "ask"), F.lit(False))
    # one row a symbol comes back to the fills: Spark broadcasts it, or splits the join of a hot symbol
    some = fills.groupBy("symbol").agg(F.bool_or(plain).alias("_some")).withColumnRenamed("symbol", "_s")
    met = fills.join(some, F.col("symbol") == F.col("_s"))
    return met.where(F.when(F.col("_some"), plain).otherwise(F.lower("direction").contains("long"))).drop("_s", "_some")


def scaled(column: str, places: int) -> Column:
    """A double times 10^places, rounded half away from zero: a key of values that agree to so many places.

    The product is rounded as it is, as SQL engines do. ``F.round`` of the value itself goes by its shortest decimal
    form, so 0.285 (whose product with 100 lies below 28.5) would get another key."""
    return F.round(F.col(column) * F.lit(10.0**places), 0)


def equal_pairs(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Number of pairs of a sell and a buy with equal keys, from counts of both sides: no pair is formed."""
    per = fills.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count_if(F.col("side") == "sell").alias("a"), F.count_if(F.col("side") == "buy").alias("b"))
    return per.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


def dropped(fills: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(symbol, ingest_idx, t, n_dropped): rows after which the stored index jumps, in one global order.

    Blocks of the index are ordered apart; the edge of the next block closes each."""
    b = F.floor(F.col("ingest_idx") / block)
    rows = fills.select("symbol", "side", "notional", "t", "ingest_idx", b.alias("_b"))
    firsts = rows.groupBy("_b").agg(F.min("ingest_idx").alias("_f")).withColumn("_next", F.lead("_f").over(Window.orderBy("_b"))).select("_b", "_next")
    inside = rows.withColumn("_l", F.lead("ingest_idx").over(Window.partitionBy("_b").orderBy("ingest_idx"))).join(firsts, "_b")
    gap = F.coalesce("_l", "_next") - F.col("ingest_idx") - 1
    return inside.withColumn("n_dropped", gap).where("n_dropped > 0").drop("_b", "_l", "_next")


def reinstated(fills: DataFrame, drops: DataFrame) -> DataFrame:
    """``fills`` with each row before a jump repeated n_dropped times."""
    again = fills.join(drops.select("ingest_idx", "n_dropped"), "ingest_idx").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n_dropped").cast("int"))))
    return fills.unionByName(again.select(*fills.columns))


def grid_gaps(rows: DataFrame, step_min: int = 1) -> DataFrame:
    """Grid points, missing ones, rows off the grid and the longest gap in minutes, per symbol."""
    step = step_min * MINUTE
    day = F.floor(F.col("t") / DAY)
    points = rows.select("symbol", F.floor(F.col("t") / step).alias("g")).distinct()
    span = rows.groupBy("symbol").agg(F.floor(F.min("t") / step).alias("a"), F.floor(F.max("t") / step).alias("z"), F.count_if(F.col("t") % step != 0).alias("off_grid"))
    have = points.groupBy("symbol").agg(F.count("*").alias("have"))
    w = Window.partitionBy("symbol", "_d").orderBy("t")
    inner = rows.withColumn("_d", day).withColumn("_g", F.col("t") - F.lag("t").over(w)).groupBy("symbol", "_d").agg(F.max("_g").alias("_g"), F.min("t").alias("_f"), F.max("t").alias("_l"))
    across = inner.withColumn("_x", F.col("_f") - F.lag("_l").over(Window.partitionBy("symbol").orderBy("_d"))).groupBy("symbol").agg((F.greatest(F.max("_g"), F.max("_x")) / MINUTE).alias("max_gap_min"))
    return span.join(have, "symbol").join(across, "symbol").select("symbol", (F.col("z") - F.col("a") + 1).alias("grid_points"), (F.col("z") - F.col("a") + 1 - F.col("have")).alias("missing"), "off_grid", "max_gap_min")


def duplicates(fills: DataFrame, keys: tuple[str, ...] = ("symbol", "t", "side", "px", "sz")) -> DataFrame:
    """Rows, distinct times, rows that share a time, and exact repeats, per symbol."""
    per = fills.groupBy("symbol", "t").agg(F.count("*").alias("n"))
    a = per.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.count("*").alias("distinct_times"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared_rows"))
    b = fills.groupBy(*keys).agg(F.count("*").alias("n")).groupBy("symbol").agg((F.sum("n") - F.count("*")).alias("exact_repeats"))
    return a.join(b, "symbol")


def side_ambiguity(fills: DataFrame, drops: DataFrame) -> DataFrame:
    """Share of dropped rows, and of their number, at times at which both sides occur."""
    both = fills.groupBy("symbol", "t").agg((F.min("side") != F.max("side")).alias("both"))
    d = drops.join(both, ["symbol", "t"])
    return d.groupBy("symbol").agg(F.sum("n_dropped").alias("n_dropped"), (F.sum(F.col("n_dropped") * F.col("both").cast("int")) / F.sum("n_dropped")).alias("ambiguous_share"))


def tables_equal(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One row: unmatched rows on either side, and cells that differ (numbers by more than the tolerance)."""
    values = [c for c in a.columns if c not in keys]
    kinds = dict(a.dtypes)
    x = a.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in values])
    y = b.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in values])
    def differs(c: str):
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] in ("double", "float"):
            return F.when(p.isNull() | q.isNull(), ~p.eqNullSafe(q)).otherwise(F.abs(p - q) > tolerance)
        return ~p.eqNullSafe(q)
    met = x.join(y, keys, "full")
    cells = sum((F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), differs(c).cast("int")).otherwise(0) for c in values), F.lit(0))
    return met.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.coalesce(F.sum(cells), F.lit(0)).alias("cells"))


def manifest(spark: SparkSession, paths: str, expected: DataFrame) -> DataFrame:
    """Files whose SHA-256 differs from ``expected`` (name, sha256) or that are missing; empty if all is well."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(files, "name", "left").where(~F.col("found").eqNullSafe(F.col("sha256")))


def missing_days(rows: DataFrame) -> DataFrame:
    day = F.floor(F.col("t") / DAY).cast("bigint")
    have = rows.select("symbol", day.alias("d")).distinct()
    want = rows.groupBy("symbol").agg(F.min(day).alias("a"), F.max(day).alias("z")).select("symbol", F.explode(F.sequence("a", "z")).alias("d"))
    return want.join(have, ["symbol", "d"], "left_anti")


class Mismatch(ValueError):
    """A rebuilt table that is not the stored one."""


def verified(rebuilt: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``rebuilt``, written; ends in ``Mismatch`` if its rows or cells are not those of ``stored``.

    The expectations are observed while the table is written: rows that only one side has, and for every column the cells
    that differ with the smallest key among them. Keys are unique on both sides; nulls equal nulls."""
    values, kinds = [c for c in rebuilt.columns if c not in keys], dict(rebuilt.dtypes)
    mine = rebuilt.select(*keys, F.lit(1).alias("_a"), *values)
    other = stored.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"_s_{c}") for c in values])
    met = mine.join(other, keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])

    def differs(c: str):
        p, q = F.col(c), F.col(f"_s_{c}")
        far = F.abs(p - q) > tolerance if kinds[c] in ("double", "float") else p != q
        return both & F.coalesce(far, p.isNull() != q.isNull())

    watch = Observation("verified")
    found = [F.count_if(F.col("_b").isNull()).alias("only_rebuilt"), F.min(F.when(F.col("_b").isNull(), name)).alias("first_only_rebuilt"), F.count_if(F.col("_a").isNull()).alias("only_stored"), F.min(F.when(F.col("_a").isNull(), name)).alias("first_only_stored")]
    for i, c in enumerate(values):
        found += [F.count_if(differs(c)).alias(f"n_{i}"), F.min(F.when(differs(c), name)).alias(f"at_{i}")]
    out = staged(met.observe(watch, *found).where("_a is not null").select(*rebuilt.columns))
    got = watch.get
    faults = [f"{got[n]} rows only in the {side} table, first {got[f'first_{n}']}" for n, side in (("only_rebuilt", "rebuilt"), ("only_stored", "stored")) if got[n]]
    faults += [f"{got[f'n_{i}']} cells of {c} differ, first at {got[f'at_{i}']}" for i, c in enumerate(values) if got[f"n_{i}"]]
    if faults:
        raise Mismatch("; ".join(faults))
    return out


def expected(summary: DataFrame, keys: list[str], values: dict[tuple, dict[str, float]], tolerance: float = 1e-12) -> DataFrame:
    """``summary`` (few rows: counts, medians, coefficients of groups), ending in ``Mismatch`` if a value is not the published
    one. ``values``: by the group's key, the figures that must hold."""
    got = {tuple(r[k] for k in keys): r for r in summary.where(F.array_contains(F.array(*[F.lit("|".join(map(str, k))) for k in values]), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).collect()}
    faults = []
    for key, figures in values.items():
        for name, want in figures.items():
            have = None if key not in got else got[key][name]
            if have is None or abs(have - want) > tolerance:
                faults.append(f"{name} of {':'.join(map(str, key))} is {have}, not {want}")
    if faults:
        raise Mismatch("; ".join(faults))
    return summary

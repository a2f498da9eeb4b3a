"""As-of and range lookups by bucketed equi-joins and windows: no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAY, MINUTE


def asof(probes: DataFrame, rows: DataFrame, values: list[str], max_age_min: float | None = None, by: str = "symbol", at: str = "t", order: str | None = "ingest_idx") -> DataFrame:
    """Each probe with the last row at or before it, null if older than ``max_age_min``; of rows with one time
    the last stored counts. Two levels: a window in each (key, day), then the last row of an earlier
    day, so that no task holds a whole key. Adds ``values`` and ``<first value>_t``."""
    packed = F.struct(F.col("t").alias("t"), *[F.col(v).alias(v) for v in values])
    tie = F.col(order) if order and order in rows.columns else F.lit(0)
    day = lambda c: F.floor(c / DAY)
    r = rows.select(F.col(by).alias("_k"), F.col("t").alias("_at"), F.lit(0).alias("_probe"), tie.cast("bigint").alias("_tie"), packed.alias("_v"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_p"))
    p = probes.select(F.col(by).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast("bigint").alias("_tie"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct("*").alias("_p"))
    both = p.unionByName(r).withColumn("_d", day(F.col("_at")))
    w = Window.partitionBy("_k", "_d").orderBy("_at", "_probe", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", True).over(w)).where("_probe = 1")
    # the last row of each day, carried to later days: one row a key and day
    ends = r.groupBy("_k", day(F.col("_at")).alias("_d")).agg(F.max_by("_v", F.struct("_at", "_tie")).alias("_e"))
    days = p.select("_k", day(F.col("_at")).alias("_d")).distinct().join(ends, ["_k", "_d"], "full")
    before = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("_k", "_d", F.last("_e", True).over(before).alias("_b"))
    out = found.join(carried, ["_k", "_d"], "left").withColumn("_v", F.coalesce("_v", "_b"))
    fresh = F.lit(True) if max_age_min is None else F.col("_at") - F.col("_v.t") <= int(max_age_min * MINUTE)
    return out.select("_p.*", *[F.when(fresh, F.col(f"_v.{v}")).alias(v) for v in values], F.when(fresh, F.col("_v.t")).alias(f"{values[0]}_t"))


def in_range(events: DataFrame, rows: DataFrame, lo: Column, hi: Column, by: str = "symbol", time: str = "t") -> DataFrame:
    """Inner join of each event with the rows whose time is in [lo, hi], over day buckets."""
    left = events.withColumn("_lo", lo).withColumn("_hi", hi)
    left = left.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_lo") / DAY), F.floor(F.col("_hi") / DAY))))
    right = rows.withColumn("_rd", F.floor(F.col(time) / DAY)).withColumnRenamed(by, "_rk")
    on = (F.col(by) == F.col("_rk")) & (F.col("_d") == F.col("_rd")) & F.col(time).between(F.col("_lo"), F.col("_hi"))
    return left.join(right, on).drop("_lo", "_hi", "_d", "_rd", "_rk")


def fill_limited(rows: DataFrame, column: str, limit: int, by: str = "symbol", time: str = "t") -> DataFrame:
    """Forward fill of at most ``limit`` grid rows from one value."""
    w = Window.partitionBy(by).orderBy(time)
    run = F.sum(F.col(column).isNotNull().cast("int")).over(w)
    n = F.row_number().over(Window.partitionBy(by, "_run").orderBy(time))
    out = rows.withColumn("_run", run).withColumn("_n", n)
    filled = F.first(column).over(Window.partitionBy(by, "_run").orderBy(time))
    return out.withColumn(column, F.when((F.col("_run") > 0) & (F.col("_n") <= limit + 1), filled)).drop("_run", "_n")


def forward(probes: DataFrame, rows: DataFrame, value: str, at: str, by: str = "symbol") -> DataFrame:
    """First row at or after each probe, of any age: the mirror of ``asof``."""
    back = rows.select(by, (-F.col("t")).alias("t"), value, F.lit(0).alias("ingest_idx"))
    return asof(probes.withColumn("_neg", -F.col(at)), back, [value], by=by, at="_neg").drop("_neg", f"{value}_t")

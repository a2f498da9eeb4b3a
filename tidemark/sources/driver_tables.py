"""The events table as fills, snapshots and bars. Times are microseconds since 1970 (``t``, UTC).

Integer times keep every range frame and bucket key exact, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lookups import asof
from ..params import DAY, MINUTE


def micros(column: str):
    """Microseconds of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast({column} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_events(raw: DataFrame) -> DataFrame:
    symbol = F.when(F.col("user_id") % 2 == 0, "BTC").otherwise("ETH")
    return raw.select(F.col("event_id").alias("ingest_idx"), micros("ts").alias("t"), symbol.alias("symbol"), "event_type", "value", "user_id")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_fills(events(spark, sf_dir))


def fill_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fills as a stream of the table's files. A stream takes a single file only by a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_fills(as_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")))


def as_fills(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    direction = F.when(kind == "view", "Close Long").when(kind == "click", "Liquidated Cross Long").when(kind == "error", "Liquidated Isolated Long").when(kind == "purchase", "Close Short").otherwise("Liquidated Cross Short")
    side = F.when(kind.isin("view", "click", "error"), "sell").otherwise("buy")
    return rows.select("ingest_idx", "t", "symbol", side.alias("side"), direction.alias("direction"), F.lit(100.0).alias("px"), (F.col("value") / 100).alias("sz"), F.lit(True).alias("is_liquidation"), F.col("value").alias("notional"))


def snapshots(spark: SparkSession, sf_dir: str, calm: bool = False) -> DataFrame:
    """Price, open interest and funding from the value of an event. ``calm``: open interest hardly moves in every other
    half day, so that events of both classes occur at every size of the tables."""
    v = F.col("value")
    swing = F.when(F.floor(F.col("t") / (DAY // 2)) % 2 == 0, 10.0).otherwise(0.02) if calm else F.lit(10)
    return events(spark, sf_dir).select("ingest_idx", "t", "symbol", (100 + v / 50).alias("px"), (1000 + swing * v).alias("oi"), ((v - 50) / 1e6).alias("funding"))


def bounds(rows: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, c0, c1): midnight before the smallest ``first``, and after the largest ``last``."""
    day = lambda c: (F.floor(c / DAY) * DAY).cast("bigint")
    return rows.groupBy("symbol").agg(day(F.min(first)).alias("c0"), (day(F.max(last)) + DAY).alias("c1"))


def coverage(rows: DataFrame) -> DataFrame:
    """(symbol, c0, c1): midnight before the first row, and after the last, over all rows."""
    return bounds(rows, "t", "t")


def dense(spark: SparkSession, sf_dir: str, calm: bool = False) -> DataFrame:
    """Snapshots on a full one-minute grid, each the last raw one at or before it."""
    raw = snapshots(spark, sf_dir, calm)
    grid = coverage(raw).select("symbol", F.explode(F.sequence("c0", F.col("c1") - MINUTE, F.lit(MINUTE))).alias("t"))
    return asof(grid, raw, ["px", "oi", "funding"]).where("px is not null").select("symbol", "t", "px", "oi", "funding")


def bars(snaps: DataFrame, minutes: int = 5) -> DataFrame:
    """Open, high, low and close per bar; empty bars are absent and volume is null."""
    width = minutes * MINUTE
    start = (F.floor(F.col("t") / width) * width).cast("bigint")
    return snaps.groupBy("symbol", start.alias("bar")).agg(F.min_by("px", "t").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "t").alias("close")).withColumn("volume", F.lit(None).cast("double")).withColumn("bar_end", F.col("bar") + width)


def first_of(rows: DataFrame, keys: list[str], order: str = "ingest_idx") -> DataFrame:
    """The first stored row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")

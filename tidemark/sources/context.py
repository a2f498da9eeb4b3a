"""Landed archive tables with names of their own, as snapshots and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which archives give each column (fixed values), best first.
NAMES = {
    "symbol": ("coin", "asset", "symbol", "name"), "t": ("time", "ts", "timestamp"), "oi": ("open_interest", "openinterest", "oi"), "oi_value": ("oi_value", "open_interest_value"),
    "mid": ("mid_px", "midpx"), "mark": ("mark_px", "markpx"), "oracle": ("oracle_px", "oraclepx"), "funding": ("funding", "funding_rate"),
}


def named(raw: DataFrame, what: str) -> Column | None:
    """The first column of ``raw`` that has one of the names, case aside."""
    have = {c.lower(): c for c in raw.columns}
    return next((F.col(f"`{have[n]}`") for n in NAMES[what] if n in have), None)


def asset_context(raw: DataFrame) -> DataFrame:
    """(symbol, t, oi, oi_value, px, funding): price from mid, else mark, else oracle; what does not read as a number
    is null, and rows without time or open interest go."""
    number = lambda what: F.lit(None).cast("double") if named(raw, what) is None else named(raw, what).try_cast("double")
    px = F.coalesce(number("mid"), number("mark"), number("oracle"))
    out = raw.select(named(raw, "symbol").alias("symbol"), named(raw, "t").try_cast("bigint").alias("t"), number("oi").alias("oi"), number("oi_value").alias("oi_value"), px.alias("px"), number("funding").alias("funding"))
    return out.na.drop(subset=["t", "oi"])


def reservoir_fills(raw: DataFrame) -> DataFrame:
    """(kind, symbol, t, side, direction, px, sz, is_liquidation, notional) from fills with texts for numbers; a row
    is of kind ``liquidations`` and, if it closes by force, of kind ``adl`` too. Rows without time or notional go."""
    px, sz = F.col("price").try_cast("double"), F.col("size").try_cast("double")
    rows = raw.select("coin", F.col("timestamp").try_cast("bigint").alias("t"), "side", "direction", px.alias("px"), sz.alias("sz"), "is_liquidation", (px * sz).alias("notional")).withColumnRenamed("coin", "symbol").na.drop(subset=["t", "notional"])
    kinds = F.filter(F.array(F.when(F.col("is_liquidation"), "liquidations"), F.when(F.col("direction").contains("Close Short"), "adl")), lambda k: k.isNotNull())
    return rows.select(F.explode(kinds).alias("kind"), "*")

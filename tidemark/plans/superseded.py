"""The superseded track: its outcomes, classes, prototype triggers, validators, and how its events match the corrected ones.

Its rules are kept as they were: left labels, ranges closed at both ends, recovery from the trough bar itself,
horizons without a largest age, and a day's censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clock, lookups, measures
from ..params import DAY, MINUTE, Study
from ..storage import staged, tidied

M = MINUTE
LABELS = ("deleverage", "middle", "churn", "unknown")


def bars_with_oi(bars: DataFrame, snaps: DataFrame, limit: int = 12) -> DataFrame:
    """Bars with the open interest at their label, filled forward over at most ``limit`` bars."""
    joined = bars.join(snaps.select("symbol", F.col("t").alias("bar"), "oi"), ["symbol", "bar"], "left")
    return lookups.fill_limited(joined, "oi", limit, time="bar")


def session(at: Column) -> Column:
    """Trading session by the hour in UTC."""
    hour = F.floor(F.pmod(at, F.lit(DAY)) / (60 * M))
    return F.when(hour < 8, "asia").when(hour < 13, "eu").when(hour < 17, "eu_us_overlap").otherwise("us")


@tidied
def outcomes(ev: DataFrame, grid: DataFrame, p: Study, censor_h: int = 24, trough_h: int = 2) -> DataFrame:
    """Outcomes and class of each (symbol, t0); events without a bar in the half hour before go.

    Two range joins in day buckets: all that lies near the event in one aggregate, then the recovery."""
    ev, grid, t0 = staged(ev), staged(grid), F.col("t0")
    since = lambda c: F.when(F.col("bar") >= t0, c)
    near = lookups.in_range(ev.select("symbol", "t0"), grid.select("symbol", "bar", "close", "low", "oi"), t0 - 60 * M, t0 + trough_h * 60 * M, time="bar")
    met = near.groupBy("symbol", "t0").agg(
        measures.still(F.when(F.col("bar").between(t0 - 30 * M, t0 - 5 * M), F.col("close"))).alias("p0"),
        F.min(since(F.col("low"))).alias("_low"), F.min_by("bar", since(F.struct("low", "bar"))).alias("_trough"),
        measures.ordered_mean(F.when(F.col("bar") <= t0, F.col("oi")), "bar").alias("_b"), F.min(since(F.col("oi"))).alias("_l"),
    )
    out = staged(ev.join(met.where("p0 is not null"), ["symbol", "t0"]))
    stop = t0 + censor_h * 60 * M
    later = lookups.in_range(out.select("symbol", "t0", "p0", "_trough"), grid.select("symbol", "bar", "high"), F.coalesce("_trough", "t0"), stop, time="bar")
    hit = later.where(F.col("high") >= F.col("p0") * (1 - p.outcome.tolerance)).groupBy("symbol", "t0").agg(F.min("bar").alias("_hit"))
    out = out.join(hit, ["symbol", "t0"], "left")
    closes = grid.select("symbol", F.col("bar").alias("t"), "close")
    for h in (6, 24):
        out = lookups.forward(staged(out).withColumn("_at", t0 + h * 60 * M), closes, "close", "_at").withColumn(f"perm_{h}h", F.log(F.col("close") / F.col("p0"))).drop("close", "_at")
    out = out.withColumn("peak_disloc", F.log(F.col("_low") / F.col("p0"))).withColumn("doi", F.when(F.col("_b") != 0, (F.col("_l") - F.col("_b")) / F.col("_b")))
    out = out.withColumn("ttr_min", F.coalesce((F.col("_hit") - t0) / M, F.lit(float(censor_h * 60)))).withColumn("censored", F.col("_hit").isNull())
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("perm_6h") / F.col("peak_disloc")))
    out = out.withColumn("transitory_share", F.when(F.col("perm_6h").isNotNull() & (F.col("peak_disloc") != 0), share)).withColumn("session", session(t0))
    out = measures.classify(out.withColumnRenamed("t0", "e0"), p, LABELS).withColumnRenamed("e0", "t0")
    return out.withColumnRenamed("doi", "doi_event").drop("_low", "_trough", "_b", "_l", "_hit", "contraction_cut")


def prototype_outcomes(ev: DataFrame, grid: DataFrame, p: Study) -> DataFrame:
    """Outcomes of prototype events with the depth of their triggers and three sessions; no classes."""
    hour = F.floor(F.pmod("t0", F.lit(DAY)) / (60 * M))
    return outcomes(ev, grid, p).drop("klass").withColumn("session", F.when(hour < 7, "asia").when(hour < 13, "eu").otherwise("us"))


def prototype_events(grid: DataFrame, p: Study, rows: int = 12, oi_q: float = 0.01, ret_q: float = 0.05, least: int = 2016) -> DataFrame:
    """Chains of bars whose hourly change of open interest and return are both in the low tail of their trail,
    the bar itself included; each with its worst values."""
    w = Window.partitionBy("symbol").orderBy("bar")
    g = staged(grid.select("symbol", F.col("bar").alias("e"), (F.col("oi") / F.lag("oi", rows).over(w) - 1).alias("doi"), F.log(F.col("close") / F.lag("close", rows).over(w)).alias("ret")))
    for column, q in (("doi", oi_q), ("ret", ret_q)):
        cut = clock.thresholds(g.select("symbol", "e", F.col(column).alias("r")), p.but(inclusive=True, quantile=q), least)
        g = staged(g.join(cut.select("symbol", "e", F.col("thr").alias(f"{column}_thr")), ["symbol", "e"]))
    chains = clock.chained(g.where("doi <= doi_thr and ret <= ret_thr"), p).groupBy("symbol", "chain").agg(F.min("e").alias("t0"), F.max("e").alias("t1"))
    met = lookups.in_range(chains.select("symbol", "t0", "t1"), g.select("symbol", "e", "doi", "ret"), F.col("t0"), F.col("t1"), time="e")
    return met.groupBy("symbol", "t0", "t1").agg(F.min("doi").alias("doi_trigger"), F.min("ret").alias("ret_trigger"))


def validators(ev: DataFrame, closing: DataFrame, funding: DataFrame, bars: DataFrame) -> DataFrame:
    """Outside checks of each event: whether forced closing followed, the swing of funding, and later volatility."""
    ev, t0 = staged(ev.select("symbol", "t0")), F.col("t0")
    adl = lookups.in_range(ev, closing.select("symbol", "t", "notional"), t0, t0 + 120 * M).groupBy("symbol", "t0").agg((F.sum("notional") > 0).alias("_a"))
    f = lookups.in_range(ev, funding.select("symbol", "t", "funding"), t0 - 60 * M, t0 + 120 * M)
    swing = f.groupBy("symbol", "t0").agg((F.avg(F.when(F.col("t") >= t0, F.col("funding"))) - F.avg(F.when(F.col("t") <= t0, F.col("funding")))).alias("funding_swing"))
    b = lookups.in_range(ev, bars.select("symbol", "bar", "close"), t0 + 120 * M, t0 + 720 * M, time="bar")
    r = b.withColumn("_r", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol", "t0").orderBy("bar"))))
    vol = r.groupBy("symbol", "t0").agg(F.when(F.count("_r") > 3, F.stddev_samp("_r")).alias("post_vol"))
    out = ev.join(adl, ["symbol", "t0"], "left").join(swing, ["symbol", "t0"], "left").join(vol, ["symbol", "t0"], "left")
    return out.withColumn("adl", F.coalesce("_a", F.lit(False))).drop("_a")


@tidied
def membership(old: DataFrame, new: DataFrame, table: DataFrame, p: Study, symbol_blind: bool = False) -> DataFrame:
    """Each old event (symbol, t0, t1, klass) with the onset of its own bin, else the first one near it, else why
    it is gone; and the onsets no old event meets. Matching holds the symbol too; with ``symbol_blind`` an onset is no
    longer new where an event of any symbol met its time, as the superseded comparison has it.

    One range join finds both kinds of match, as the own bin lies in the near range."""
    old, new, width = staged(old), staged(new.select("symbol", "e0", "klass", "analysable", "reason")), p.clock.width_min * M
    own = F.col("t0") + width
    met = lookups.in_range(old.select("symbol", "t0", "t1"), new.withColumnRenamed("klass", "_klass"), F.col("t0") - p.clock.quiet_min * M, F.col("t1") + 2 * width, time="e0")
    best = met.groupBy("symbol", "t0").agg(F.min_by(F.struct("e0", "_klass", "analysable", "reason"), F.struct(F.col("e0") != own, F.col("e0"))).alias("_m"))
    span = lookups.in_range(old.select("symbol", "t0", "t1"), table.select("symbol", "e", "eligible", "trigger"), own, F.col("t1") + width, time="e")
    why = span.groupBy("symbol", "t0").agg(F.bool_or("eligible").alias("_el"), F.bool_or("trigger").alias("_tr"))
    m = staged(old.join(best, ["symbol", "t0"], "left").join(why, ["symbol", "t0"], "left"))
    gone, e0 = F.col("_m").isNull(), F.col("_m.e0")
    # fixed values: the texts of causes and states
    cause = F.when(~F.coalesce("_el", F.lit(False)), "before full warm-up").when(~F.col("_tr"), "no bin exceeds prior-only threshold").otherwise("absorbed into an earlier corrected chain")
    matched = m.select(
        "symbol", F.col("t0").alias("legacy_t0"), F.col("klass").alias("legacy_class"),
        F.when(gone, "dropped").when(e0 == own, "same onset bin").otherwise("onset shifted").alias("status"),
        e0.alias("e0"), F.col("_m._klass").alias("corrected_class"), F.coalesce("_m.analysable", F.lit(False)).alias("analysable"),
        F.when(gone, cause).otherwise(F.col("_m.reason")).alias("exclusion"), F.when(e0 != own, (e0 - own) / M).alias("shift_min"),
    )
    on = ["e0"] if symbol_blind else ["symbol", "e0"]
    fresh = new.join(matched.where("e0 is not null").select(*on).distinct(), on, "left_anti")
    fresh = fresh.select("symbol", F.lit(None).cast("bigint").alias("legacy_t0"), F.lit(None).cast("string").alias("legacy_class"), F.lit("new in corrected").alias("status"), "e0", F.col("klass").alias("corrected_class"), "analysable", F.col("reason").alias("exclusion"), F.lit(None).cast("double").alias("shift_min"))
    return matched.unionByName(fresh)

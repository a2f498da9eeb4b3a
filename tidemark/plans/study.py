"""Whole studies: the corrected one, the legacy track, grids and tables over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import clock, lookups, measures
from ..params import DAY, MINUTE, Study
from ..sources import driver_tables as src
from ..storage import staged, tidied


@tidied
def build(spark: SparkSession, sf_dir: str, p: Study, calm: bool = False) -> DataFrame:
    """Fills to classified onsets, all symbols at once; written, as most readers use it more than once."""
    snaps = staged(src.dense(spark, sf_dir, calm))
    bars = staged(src.bars(snaps))
    ev = clock.onsets(clock.triggers(src.fills(spark, sf_dir), p), p)
    return measures.measured(ev, bars, snaps, p)


def clustered(ev: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds episode and calendar clusters (of each key ``by`` for itself); built on all events, to be filtered afterwards."""
    out = ev = staged(ev)
    for name, hours in (("ep6", 6), ("ep24", 24)):
        ids = clock.islands(ev.select(*by, "symbol", "e0"), hours * 60 + 45, name=name, by=by)
        out = out.join(ids, [*by, "symbol", "e0"])
    return calendar(out).withColumn("none", F.concat_ws(":", "symbol", "e0"))


def calendar(ev: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("e0") / DAY).cast("int"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return ev.withColumn("day", day.cast("string")).withColumn("week", week)


def contrast(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("analysable") & F.col("klass").isin("contraction", "limited"))


def class_table(ev: DataFrame) -> DataFrame:
    med = lambda c, name: F.expr(f"percentile({c}, 0.5D)").alias(name)
    return ev.where("analysable").groupBy("klass").agg(
        F.count("*").alias("n"), F.count_if(F.col("symbol") == "BTC").alias("n_btc"), F.count_if(F.col("symbol") == "ETH").alias("n_eth"),
        med("disp", "med_disp"), med("doi", "med_doi"), med("reversion", "med_reversion"),
        F.avg(F.col("rec_event").cast("int")).alias("recovered"), F.avg((~F.col("rec_complete")).cast("int")).alias("incomplete"),
    )


def cluster_summary(ev: DataFrame, cluster: str = "ep6") -> DataFrame:
    per = contrast(ev).groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(F.col("klass") == "contraction").alias("a"), F.count_if(F.col("klass") == "limited").alias("b"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("g"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("g_mixed"), F.count_if(F.col("a") > 0).alias("g_contraction"), F.count_if(F.col("b") > 0).alias("g_limited"), F.max("n").alias("max_size"), F.expr("percentile(n, 0.5D)").alias("median_size"))


def legacy_threshold(fills: DataFrame, p: Study) -> DataFrame:
    """Left labels, partial rolling sums, threshold with the current bin and at least seven days of it."""
    q = p.but(label="left", inclusive=True)
    return clock.thresholds(clock.rolled_partial(clock.bins(fills, q)), q, least=2016)


def legacy_events(fills: DataFrame, p: Study) -> DataFrame:
    t = legacy_threshold(fills, p)
    chains = clock.chained(t.where((F.col("r") >= F.col("thr")) & (F.col("r") > 0)), p)
    spans = chains.groupBy("symbol", "chain").agg(F.min("e").alias("t0"), F.max("e").alias("t1"))
    met = lookups.in_range(spans.select("symbol", "t0", "t1"), t.select("symbol", "e", "r"), F.col("t0"), F.col("t1"), time="e")
    return met.groupBy("symbol", "t0", "t1").agg(F.max("r").alias("liq_notional"))


def overlapping(ev: DataFrame, runs: DataFrame, p: Study, keys: tuple[str, ...] = ("symbol", "e0")) -> DataFrame:
    """Adds ``overlaps``: whether the event's window meets a run, by day buckets of both."""
    a, b = F.col("e0") - p.window.before_min * MINUTE, F.col("e0") + p.window.after_min * MINUTE
    left = ev.withColumn("_d", F.explode(F.sequence(F.floor(a / DAY), F.floor(b / DAY))))
    right = runs.select(F.col("symbol").alias("_s"), "run_start", "run_end", F.explode(F.sequence(F.floor(F.col("run_start") / DAY), F.floor(F.col("run_end") / DAY))).alias("_rd"))
    hit = left.join(right, (F.col("symbol") == F.col("_s")) & (F.col("_d") == F.col("_rd")) & (F.col("run_start") < b) & (F.col("run_end") > a)).select(*keys).distinct().withColumn("_h", F.lit(True))
    return ev.join(hit, list(keys), "left").withColumn("overlaps", F.coalesce("_h", F.lit(False))).drop("_h")


def lagged_changes(bars: DataFrame, rows: int) -> DataFrame:
    before = F.lag("close", rows).over(Window.partitionBy("symbol").orderBy("bar"))
    return bars.select("symbol", "bar", (F.col("close") / before - 1).alias("pct"), F.log(F.col("close") / before).alias("logret"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return stats.average_ranks(stats.average_ranks(pairs, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry").alias("rho"))


def economic(bars: DataFrame) -> DataFrame:
    daily = bars.groupBy("symbol", F.floor(F.col("bar") / DAY).alias("d")).agg(F.max_by("close", "bar").alias("close"))
    r = daily.select("symbol", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("d"))).alias("r"))
    return r.groupBy("symbol").agg(F.stddev_samp("r").alias("vol"), F.expr("percentile(abs(r), 0.5D)").alias("median_abs"))

"""Robustness of the superseded track: its headline contrast, grids of triggers, rules, subsets and windows, validators and
continuous measures. Variants share one trail, one chain pass and one pass over the bars; cells of a grid are keys of
one aggregate and of one permutation test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import permutation, stats
from ..operators import clock, lookups, measures
from ..params import MINUTE, Study
from ..storage import staged, tidied
from .superseded import LABELS

M = MINUTE


@dataclass(frozen=True)
class Variant:
    """One build of superseded events: trigger quantile, merge limit, trough and censoring horizons."""

    name: str
    quantile: float = 0.99
    merge_min: int = 120
    trough_h: int = 2
    censor_h: int = 24


#: The windows grid changes one setting at a time.
WINDOWS = (*[Variant(f"trough(h) {v}", trough_h=v) for v in (1, 2, 3)], *[Variant(f"recovery(h) {v}", censor_h=v) for v in (12, 24, 48)], *[Variant(f"merge(min) {v}", merge_min=v) for v in (60, 120, 180)])
TRIGGERS = (Variant("0.99"), Variant("0.95", quantile=0.95))


def chains(fills: DataFrame, p: Study, variants: tuple[Variant, ...], least: int = 2016) -> DataFrame:
    """(clock, symbol, t0, t1, liq_notional) of every (quantile, merge limit): one ordered trail, one pass over gaps."""
    q = p.but(label="left", inclusive=True)
    quantiles = tuple(dict.fromkeys(v.quantile for v in variants))
    t = staged(clock.thresholds(clock.rolled_partial(clock.bins(fills, q)), q, least, quantiles).select("symbol", "e", "r", "thr"))
    cases = []
    for i, (quantile, merge) in enumerate(dict.fromkeys((v.quantile, v.merge_min) for v in variants)):
        thr = F.element_at("thr", quantiles.index(quantile) + 1)
        cases.append(F.when((F.col("r") > 0) & (F.col("r") >= thr), F.struct(F.lit(i).alias("clock"), F.lit(merge).alias("quiet"))))
    fired = t.select("symbol", "e", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")).select("symbol", "e", "x.*")
    spans = clock.chained(fired, p, by=["clock", "symbol"], quiet=F.col("quiet")).groupBy("clock", "symbol", "chain").agg(F.min("e").alias("t0"), F.max("e").alias("t1"))
    met = lookups.in_range(spans.drop("chain"), t.select("symbol", "e", "r"), F.col("t0"), F.col("t1"), time="e")
    return met.groupBy("clock", "symbol", "t0", "t1").agg(F.max("r").alias("liq_notional"))


def horizons(ev: DataFrame, grid: DataFrame, p: Study, troughs: tuple[int, ...], censor_h: int) -> DataFrame:
    """(symbol, t0) with base, trough and recovery for every trough horizon: one range join for what lies near the event, one
    for the first passages, whose earliest bar answers every shorter censoring."""
    grid, t0 = staged(grid), F.col("t0")
    upto = lambda h, c: F.when((F.col("bar") >= t0) & (F.col("bar") <= t0 + h * 60 * M), c)
    near = lookups.in_range(ev, grid.select("symbol", "bar", "close", "low", "oi"), t0 - 60 * M, t0 + max(troughs) * 60 * M, time="bar")
    met = near.groupBy("symbol", "t0").agg(
        measures.still(F.when(F.col("bar").between(t0 - 30 * M, t0 - 5 * M), F.col("close"))).alias("p0"), F.avg(F.when(F.col("bar") <= t0, F.col("oi"))).alias("_b"),
        *[F.min(upto(h, F.col("low"))).alias(f"_low{h}") for h in troughs], *[F.min_by("bar", upto(h, F.struct("low", "bar"))).alias(f"_at{h}") for h in troughs], *[F.min(upto(h, F.col("oi"))).alias(f"_l{h}") for h in troughs],
    )
    out = staged(ev.join(met.where("p0 is not null"), ["symbol", "t0"]))
    later = lookups.in_range(out.select("symbol", "t0", "p0", *[f"_at{h}" for h in troughs]), grid.select("symbol", "bar", "high"), t0, t0 + censor_h * 60 * M, time="bar")
    later = later.where(F.col("high") >= F.col("p0") * (1 - p.outcome.tolerance))
    hits = later.groupBy("symbol", "t0").agg(*[F.min(F.when(F.col("bar") >= F.coalesce(f"_at{h}", "t0"), F.col("bar"))).alias(f"_hit{h}") for h in troughs])
    out = out.join(hits, ["symbol", "t0"], "left")
    closes = grid.select("symbol", F.col("bar").alias("t"), "close")
    for h in (6, 24):
        out = lookups.forward(staged(out).withColumn("_goal", t0 + h * 60 * M), closes, "close", "_goal").withColumn(f"perm_{h}h", F.log(F.col("close") / F.col("p0"))).drop("close", "_goal")
    return staged(out)


@tidied
def built(fills: DataFrame, grid: DataFrame, p: Study, variants: tuple[Variant, ...]) -> DataFrame:
    """Events of all variants (variant, symbol, t0, liq_notional, doi, peak_disloc, perm_6h, perm_24h, transitory_share,
    ttr_min, censored, klass); the union of their onsets is measured once."""
    clocks = {c: i for i, c in enumerate(dict.fromkeys((v.quantile, v.merge_min) for v in variants))}
    ev = staged(chains(fills, p, variants))
    troughs = tuple(dict.fromkeys(v.trough_h for v in variants))
    wide = horizons(ev.select("symbol", "t0").distinct(), grid, p, troughs, max(v.censor_h for v in variants))
    t0, cases = F.col("t0"), []
    for v in variants:
        hit = F.col(f"_hit{v.trough_h}")
        hit = F.when(hit <= t0 + v.censor_h * 60 * M, hit)
        low, least = F.col(f"_low{v.trough_h}"), F.col(f"_l{v.trough_h}")
        one = F.struct(
            F.lit(v.name).alias("variant"), F.log(low / F.col("p0")).alias("peak_disloc"), F.when(F.col("_b") != 0, (least - F.col("_b")) / F.col("_b")).alias("doi"),
            F.coalesce((hit - t0) / M, F.lit(float(v.censor_h * 60))).alias("ttr_min"), hit.isNull().alias("censored"),
        )
        cases.append(F.when(F.col("clock") == clocks[v.quantile, v.merge_min], one))
    rows = ev.join(wide, ["symbol", "t0"]).select("symbol", "t0", "liq_notional", "perm_6h", "perm_24h", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")).select("*", "x.*").drop("x")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("perm_6h") / F.col("peak_disloc")))
    rows = rows.withColumn("transitory_share", F.when(F.col("perm_6h").isNotNull() & (F.col("peak_disloc") != 0), share)).withColumnRenamed("t0", "e0")
    return staged(measures.classify(rows, p, LABELS, by=("variant", "symbol")).withColumnRenamed("e0", "t0").drop("contraction_cut"))


def prepared(ev: DataFrame) -> DataFrame:
    """Events with the columns of the tests: size of the displacement, logarithm of size, symbol, and loss of open interest."""
    return ev.withColumns({"abs_peak": F.abs("peak_disloc"), "log_notional": F.log(F.greatest("liq_notional", F.lit(1e-9))), "asset_eth": (F.col("symbol") == "ETH").cast("double"), "oi_destroyed": -F.col("doi")})


@tidied
def headline(cells: DataFrame, keys: list[str], draws: int = 0, seed: int = 0) -> DataFrame:
    """(keys, n_d, n_c, peak_diff, peak_p, tr_diff, tr_p, lr_chi2, lr_p): medians of displacement and transitory share and the
    log-rank test of recovery, deleverage against churn, for every cell at once. peak_p and tr_p are null without
    ``draws``."""
    rows = staged(cells.where(F.col("klass").isin("deleverage", "churn")).withColumn("one", F.col("klass") == "deleverage"))
    values = F.explode(F.array(F.struct(F.lit("peak").alias("measure"), F.abs("peak_disloc").alias("v")), F.struct(F.lit("tr").alias("measure"), F.col("transitory_share").alias("v")))).alias("x")
    tests = permutation.median_tests(rows.select(*keys, "one", values).select(*keys, "one", "x.*"), [*keys, "measure"], "v", "one", draws, seed)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    wide = tests.groupBy(*keys).agg(F.coalesce(of("peak", "n1"), F.lit(0)).alias("n_d"), F.coalesce(of("peak", "n2"), F.lit(0)).alias("n_c"), of("peak", "est").alias("peak_diff"), of("peak", "p").alias("peak_p"), of("tr", "est").alias("tr_diff"), of("tr", "p").alias("tr_p"))
    test = stats.log_rank(rows.select(*keys, "klass", F.col("ttr_min").alias("d"), (~F.col("censored")).alias("ev")), "deleverage", "klass", by=tuple(keys), lone_deaths=True)
    return wide.join(test.select(*keys, F.col("chi2").alias("lr_chi2"), F.col("p").alias("lr_p")), keys, "left")


def fixed_class(p: Study) -> Column:
    return F.when(F.col("doi") <= p.classes.cut, LABELS[0]).when(F.col("doi") > p.classes.upper, LABELS[2]).otherwise(LABELS[1])


def cells(ev: DataFrame, p: Study, week: tuple[int, int]) -> DataFrame:
    """Events of TRIGGERS once for each rule and subset they belong to: memberships are an array, exploded once."""
    rules = F.explode(F.array(F.struct(F.lit("percentile").alias("rule"), F.col("klass").alias("now")), F.struct(F.lit("fixed").alias("rule"), fixed_class(p).alias("now")))).alias("x")
    member = lambda name, rule: F.when(rule, F.lit(name))
    subsets = F.filter(F.array(F.lit("all"), member("ex-week", ~F.col("t0").between(*week)), member("BTC", F.col("symbol") == "BTC"), member("ETH", F.col("symbol") == "ETH")), lambda x: x.isNotNull())
    return ev.select("*", rules).withColumn("klass", F.col("x.now")).withColumn("rule", F.col("x.rule")).drop("x").withColumn("subset", F.explode(subsets)).withColumnRenamed("variant", "trigger")


@tidied
def validators(ev: DataFrame, checks: DataFrame, draws: int = 0, seed: int = 0) -> DataFrame:
    """(measure, n1, n2, est, p): size, forced closing, funding swing and later volatility by class; one label table, and for
    each measure its own rows without a value and its own statistic."""
    rows = prepared(ev).join(checks, ["symbol", "t0"], "left").where(F.col("klass").isin("deleverage", "churn")).withColumn("one", F.col("klass") == "deleverage")
    rows = staged(rows)
    cell = lambda name: F.struct(F.lit(name).alias("measure"), F.col(name).alias("v"))
    medians = permutation.median_tests(rows.select("one", F.explode(F.array(*map(cell, ("log_notional", "funding_swing", "post_vol")))).alias("x")).select("one", "x.*"), ["measure"], "v", "one", draws, seed)
    rates = permutation.rate_tests(rows.select("one", F.lit("adl").alias("measure"), F.coalesce("adl", F.lit(False)).alias("v")), ["measure"], "v", "one", draws, seed)
    return medians.unionByName(rates.select(medians.columns))

"""Audit and description tables: coverage in long form, staged triggers and their counts, gaps, effects, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import clock, lookups
from ..params import MINUTE, Study
from . import study


def long_form(tables: list[DataFrame], key: str = "symbol") -> DataFrame:
    """(symbol, metric, value) of every other column of the tables."""
    out = None
    for t in tables:
        values = [c for c in t.columns if c != key]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("x")
        one = t.select(key, cells).select(key, "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each column, null values kept; one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return rows.select(cells).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def gap_ranges(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """Price range of the bars in each run, as 100 times the logarithm of highest over lowest; runs without bars go."""
    met = lookups.in_range(runs, bars.select("symbol", "bar", "high", "low"), F.col("run_start"), F.col("run_end"), time="bar")
    return met.groupBy("symbol", "run_start", "run_end", "hours").agg((100 * F.log(F.max("high") / F.min("low"))).alias("log_range_pct"))


def staged_triggers(fills: DataFrame, p: Study, least_days: int) -> DataFrame:
    """(symbol, e): triggers of a step between the superseded rule and the corrected one. The grid runs from the first to
    the last bin with a sell; sums are partial; a threshold needs ``least_days`` of bins."""
    b = clock.bins(fills, p)
    span = b.where("n > 0").groupBy("symbol").agg(F.min("e").alias("_a"), F.max("e").alias("_z"))
    b = b.join(span, "symbol").where(F.col("e").between(F.col("_a"), F.col("_z"))).drop("_a", "_z")
    t = clock.thresholds(clock.rolled_partial(b), p, least=1440 // p.clock.width_min * least_days)
    return t.where((F.col("r") > 0) & (F.col("r") >= F.col("thr"))).select("symbol", "e")


def waterfall(fills: DataFrame, p: Study, first_days: int) -> DataFrame:
    """(stage, symbol, triggers, onsets) of the four steps; symbol ``all`` has their sums."""
    steps = [("left", True, first_days), ("right", True, first_days), ("right", False, first_days), ("right", False, p.clock.trail_days)]
    out = None
    for i, (label, inclusive, days) in enumerate(steps):
        t = clock.chained(staged_triggers(fills, p.but(label=label, inclusive=inclusive), days), p)
        one = t.groupBy("symbol").agg(F.count("*").alias("triggers"), F.count_if("new").alias("onsets")).select(F.lit(i).cast("bigint").alias("stage"), "symbol", "triggers", "onsets")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.groupBy("stage").agg(F.lit("all").alias("symbol"), F.sum("triggers").alias("triggers"), F.sum("onsets").alias("onsets")))


def measured_stage(ev: DataFrame) -> DataFrame:
    """(stage, symbol, onsets): the waterfall's last step, onsets that could be measured and classified."""
    kept = ev.where("analysable").groupBy("symbol").agg(F.count("*").alias("onsets"))
    both = kept.unionByName(kept.agg(F.lit("all").alias("symbol"), F.coalesce(F.sum("onsets"), F.lit(0)).alias("onsets")))
    return both.select(F.lit(4).cast("bigint").alias("stage"), "symbol", "onsets")


def descriptive(ev: DataFrame, tau: float = 1320.0) -> DataFrame:
    """Counts, medians and recovery of each class of analysable events."""
    a = ev.where("analysable")
    med = lambda c, name, k=1.0: (F.percentile(F.col(c), F.lit(0.5)) * k).alias(name)
    plain = a.groupBy("klass").agg(
        F.count("*").alias("n"), med("doi", "median_doi_pct", 100.0), med("disp", "median_disp_x100", 100.0), med("p6h", "median_p6h_x100", 100.0), med("p24h", "median_p24h_x100", 100.0),
        F.count("p24h").alias("n_p24h"), F.avg(F.col("rec_event").cast("int")).alias("share_recovered"), F.avg((~F.col("rec_event") & ~F.col("rec_complete")).cast("int")).alias("share_incomplete"), med("r_onset", "median_r_onset"),
    )
    km = stats.kaplan_meier(a.select(F.col("klass").alias("grp"), F.col("rec_min").alias("d"), F.col("rec_event").alias("ev")))
    at = km.where(F.col("d") <= tau).groupBy("grp").agg(F.min("s").alias("_s"))
    area = stats.rmst(km, a.select(F.col("klass").alias("grp")).distinct(), tau)
    return plain.join(at, F.col("klass") == F.col("grp"), "left").drop("grp").join(area, F.col("klass") == F.col("grp")).drop("grp").withColumn("km_unrecovered", F.coalesce("_s", F.lit(1.0))).drop("_s").withColumnRenamed("rmst", "rmst_min")


EFFECTS = (("E1", "disp", 100.0), ("E3", "p6h", 100.0), ("E4", "p24h", 100.0), ("E5", "reversion", 1.0))


def effect_estimates(ev: DataFrame, tau: float = 1320.0) -> DataFrame:
    """(effect, n1, n2, est): contraction less limited, medians of E1, E3, E4 and E5 and restricted means of E6."""
    c = study.contrast(ev)
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("effect"), (F.col(column) * k).alias("v")) for name, column, k in EFFECTS])).alias("x")
    one, two = F.col("klass") == "contraction", F.col("klass") == "limited"
    side = lambda which: F.percentile(F.when(which, F.col("v")), F.lit(0.5))
    medians = c.select("klass", cells).select("klass", "x.*").where("v is not null").groupBy("effect").agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"), (side(one) - side(two)).alias("est"))
    rows = c.select(F.col("klass").alias("grp"), F.col("rec_min").alias("d"), F.col("rec_event").alias("ev"))
    area = stats.rmst(stats.kaplan_meier(rows), rows.groupBy("grp").agg(F.count("*").alias("n")), tau)
    of = lambda k, v: F.max(F.when(F.col("grp") == k, F.col(v)))
    six = area.agg(F.lit("E6").alias("effect"), F.coalesce(of("contraction", "n"), F.lit(0)).alias("n1"), F.coalesce(of("limited", "n"), F.lit(0)).alias("n2"), (of("contraction", "rmst") - of("limited", "rmst")).alias("est"))
    return medians.unionByName(six)


def flattened(effects: DataFrame) -> DataFrame:
    """The effects as one row: est, n1 and n2 of each, in columns."""
    of = lambda name, c: F.max(F.when(F.col("effect") == name, F.col(c))).alias(f"{name.lower()}_{c}")
    return effects.agg(*[of(f"E{i}", c) for i in (1, 3, 4, 5, 6) for c in ("est", "n1", "n2")])


def verdicts(effects: DataFrame, before: dict[str, int]) -> DataFrame:
    """(effect, est, verdict): whether an effect has the sign it had ``before``; an effect of 0 has none."""
    old = F.coalesce(*[F.when(F.col("effect") == k, F.lit(v)) for k, v in before.items()])
    return effects.select("effect", "est", F.when(F.col("est").isNull() | old.isNull(), "not comparable").when(F.signum("est") == old, "same sign").when(F.col("est") == 0, "no effect").otherwise("other sign").alias("verdict"))


def size_diagnostic(ev: DataFrame) -> DataFrame:
    """One row: rank correlation of the fall in open interest with the logarithm of size, and median sizes by class.
    Values are rounded to nine places, so that equal ones tie whatever the order of the sums behind them."""
    a = ev.where("analysable and r_onset > 0").select("klass", F.round(-F.col("doi"), 9).alias("x"), F.round(F.log("r_onset"), 9).alias("y"), "r_onset")
    med = lambda k: F.percentile(F.when(F.col("klass") == k, F.col("r_onset")), F.lit(0.5)).alias(f"median_{k}")
    return study.spearman(a, "x", "y").crossJoin(F.broadcast(a.agg(med("contraction"), med("limited"))))  # one row each


def ratios(vol: DataFrame, ev: DataFrame, coef: float = 0.0055) -> DataFrame:
    """One row: a coefficient over the median displacement and over the mean daily volatility."""
    a = ev.agg(F.percentile(F.abs("disp"), F.lit(0.5)).alias("m"))
    b = vol.agg(F.avg("vol").alias("v"))
    return a.crossJoin(F.broadcast(b)).select((F.lit(coef) / F.when(F.col("m") != 0, F.col("m"))).alias("over_displacement"), (F.lit(coef) / F.when(F.col("v") != 0, F.col("v"))).alias("over_volatility"))  # one row each


def relabelled(old: DataFrame, p: Study) -> DataFrame:
    """Superseded events under the corrected names and classes."""
    names = F.create_map(*[F.lit(x) for pair in (("deleverage", "contraction"), ("churn", "limited"), ("middle", "intermediate")) for x in pair])
    return old.select("symbol", (F.col("t0") + (p.clock.width_min * MINUTE)).alias("e0"), F.col("peak_disloc").alias("disp"), F.col("doi_event").alias("doi"), F.col("perm_6h").alias("p6h"), F.col("ttr_min").alias("rec_min"), (~F.col("censored")).alias("rec_event"), F.coalesce(F.element_at(names, F.col("klass")), F.col("klass")).alias("klass"))


def as_effect_events(old: DataFrame, p: Study) -> DataFrame:
    """Superseded events as an event table of one setting, for the corrected inference: all analysable, follow-up of a day."""
    ev = relabelled(old, p).join(old.select("symbol", (F.col("t0") + p.clock.width_min * MINUTE).alias("e0"), F.col("perm_24h").alias("p24h"), F.col("transitory_share").alias("reversion"), F.col("liq_notional").alias("intensity")), ["symbol", "e0"])
    ev = ev.withColumns({"spec": F.lit("legacy"), "analysable": F.lit(True), "sized": F.lit(True), "continuous": F.lit(False), "tau": F.lit(1440.0)})
    return study.clustered(ev).withColumn("short", F.col("ep6").cast("string")).withColumn("long", F.col("ep24").cast("string"))


def _controls(rows: DataFrame) -> list[str]:
    """The controls that the rows have: size where any is known, the symbol where there is more than one."""
    seen = rows.agg(F.count("size").alias("sizes"), F.count_distinct("eth").alias("symbols")).first()
    return ["size"] * (seen["sizes"] > 0) + ["eth"] * (seen["symbols"] > 1)


def size_regression(spark: SparkSession, ev: DataFrame, draws: int) -> DataFrame:
    """E2: 100 times the size of the displacement on the class, the logarithm of size and the symbol, by episode; the
    report is about the class. Nulls where a class has fewer than three events."""
    c = study.contrast(ev).where("disp is not null")
    rows = c.select((100 * F.abs("disp")).alias("y"), (F.col("klass") == "contraction").cast("double").alias("one"), F.when(F.col("intensity") > 0, F.log("intensity")).alias("size"), (F.col("symbol") == "ETH").cast("double").alias("eth"), "ep6")
    controls = _controls(rows)
    n = rows.na.drop(subset=controls).agg(F.count_if(F.col("one") == 1).alias("a"), F.count_if(F.col("one") == 0).alias("b")).first()
    if min(n["a"], n["b"]) < 3:
        return spark.createDataFrame([(None,) * 11 + (n["a"] + n["b"],)], stats.REPORT)
    return stats.regression_report(spark, rows, "y", ["one", *controls], "ep6", draws)


def response_regression(spark: SparkSession, ev: DataFrame, draws: int) -> DataFrame:
    """R12: 100 times the size of the displacement on the percentage of open interest lost, beside the logarithm of size
    and the symbol, over all analysable events, by episode; the report is about the loss."""
    a = ev.where("analysable")
    rows = a.select((100 * F.abs("disp")).alias("y"), (-100 * F.col("doi")).alias("lost"), F.when(F.col("intensity") > 0, F.log("intensity")).alias("size"), (F.col("symbol") == "ETH").cast("double").alias("eth"), "ep6")
    return stats.regression_report(spark, rows, "y", ["lost", *_controls(rows)], "ep6", draws)


def curves(ev: DataFrame, tau: float = 1320.0) -> DataFrame:
    """(klass, mark, rec_min, s, n_censored): the points of the survival curves of both classes: start, steps, end, and
    the level at each time at which events are censored."""
    rows = study.contrast(ev).select(F.col("klass").alias("grp"), F.col("rec_min").alias("d"), F.col("rec_event").alias("ev"))
    km = stats.kaplan_meier(rows).select("grp", "d", "s")
    lost = rows.where(~F.col("ev")).groupBy("grp", "d").agg(F.count("*").alias("n_censored"))
    none = F.lit(0).cast("bigint").alias("n_censored")
    w = Window.partitionBy("grp").orderBy("d")
    level = km.select("grp", "d", "s", none).unionByName(lost.withColumn("s", F.lit(1.0))).withColumn("s", F.min("s").over(w))
    groups = rows.select("grp").distinct()
    last = groups.join(km.groupBy("grp").agg(F.min("s").alias("s")), "grp", "left")
    parts = (
        groups.select("grp", F.lit("start").alias("mark"), F.lit(0.0).alias("d"), F.lit(1.0).alias("s"), none),
        km.select("grp", F.lit("step").alias("mark"), "d", "s", none),
        last.select("grp", F.lit("end").alias("mark"), F.lit(tau).alias("d"), F.coalesce("s", F.lit(1.0)).alias("s"), none),
        level.where("n_censored > 0").select("grp", F.lit("censored").alias("mark"), "d", "s", "n_censored"),
    )
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out.select(F.col("grp").alias("klass"), "mark", F.col("d").alias("rec_min"), "s", "n_censored")

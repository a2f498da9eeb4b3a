"""The six effects of contraction against limited events, with intervals, for many settings in one plan.

``spec`` is a column: every row of the event table belongs to a setting, and each statistic is one plan over all of them.
Event tables hold spec, symbol, klass, analysable, short and long (clusters), tau, sized and continuous (how the setting
regresses), and the measures. Effects: E1 displacement, E3 and E4 persistence, E5 reversion (differences of medians), E2
regression of the size of the displacement, E6 restricted mean time to recovery with the robust log-rank test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear, stats, tails
from ..storage import staged, tidied

#: Effects that are differences of medians: measure, factor and whether the clusters are the long ones.
MEDIANS = (("E1", "disp", 100.0, False), ("E3", "p6h", 100.0, False), ("E4", "p24h", 100.0, True), ("E5", "reversion", 1.0, False))
COLUMNS = ("spec", "effect", "n1", "n2", "clusters", "est", "lo", "hi", "p", "used", "p_cr1", "g_eff", "chi2")
LEAST = 3


def contrast(ev: DataFrame) -> DataFrame:
    """Rows of both classes with ``one``: whether the class is contraction."""
    return ev.where(F.col("analysable") & F.col("klass").isin("contraction", "limited")).withColumn("one", F.col("klass") == "contraction")


def cluster_counts(c: DataFrame, cluster: str) -> DataFrame:
    """(spec, n1, n2, g, g_mixed) of contrast rows."""
    per = c.groupBy("spec", cluster).agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b"))
    return per.groupBy("spec").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.count("*").alias("g"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("g_mixed"))


def _difference(name: str) -> Column:
    return F.max(F.when(F.col("_one"), F.col(name))) - F.max(F.when(~F.col("_one"), F.col(name)))


def _keyed(rows: DataFrame) -> DataFrame:
    """Composite keys for functions that take one group and one cluster column."""
    return rows.withColumn("_g", F.concat_ws("|", "spec", "effect", F.col("one").cast("string"))).withColumn("_cl", F.concat_ws("|", "spec", "effect", "cluster"))


def _split(found: DataFrame) -> DataFrame:
    part = F.split("_g", r"\|")
    return found.withColumn("spec", part[0]).withColumn("effect", part[1]).withColumn("_one", part[2] == "true")


def _interval(reps: DataFrame) -> DataFrame:
    """(spec, effect, lo, hi, used) of (spec, effect, b, d): percentiles of the draws in which both classes occur."""
    ci = reps.groupBy("spec", "effect").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("_c"), F.count("d").alias("used"))
    return ci.select("spec", "effect", F.element_at("_c", 1).alias("lo"), F.element_at("_c", 2).alias("hi"), "used")


def _none(ests: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return ests.select("spec", "effect", nothing.alias("lo"), nothing.alias("hi"), F.lit(0).cast("bigint").alias("used"))


def median_effects(c: DataFrame, draws: int, seed: int) -> DataFrame:
    """E1, E3, E4 and E5 of every setting: one table of values, one of multiplicities, one of weighted quantiles."""
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("effect"), (F.col(m) * k).alias("v"), F.col("long" if far else "short").alias("cluster")) for e, m, k, far in MEDIANS])).alias("x")
    rows = staged(_keyed(c.select("spec", "one", cells).select("spec", "one", "x.*").where("v is not null")))
    n = rows.groupBy("spec", "effect").agg(F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n2"), F.count_distinct("cluster").alias("clusters"))
    est = _split(stats.quantile(rows, "v", "_g", 0.5)).groupBy("spec", "effect").agg(_difference("q").alias("est"))
    if draws:
        drawn = stats.multiplicities(rows, ["spec", "effect"], "cluster", draws, seed).select("b", F.concat_ws("|", "spec", "effect", "cluster").alias("_cl"), "freq")
        reps = _split(stats.quantile(rows, "v", "_g", 0.5, "_cl", staged(drawn))).groupBy("spec", "effect", "b").agg(_difference("q").alias("d"))
        more = _interval(reps)
    else:
        more = _none(est)
    return n.join(est, ["spec", "effect"]).join(more, ["spec", "effect"], "left").withColumn("p", F.lit(None).cast("double"))


def recovery_effect(c: DataFrame, draws: int, seed: int) -> DataFrame:
    """E6 of every setting: difference of restricted means to the setting's tau; chi2 and p are the robust log-rank test's."""
    rows = staged(_keyed(c.where("rec_min is not null").select("spec", F.lit("E6").alias("effect"), "one", F.col("long").alias("cluster"), F.col("rec_min").alias("d"), F.col("rec_event").alias("ev"), "tau")))
    n = rows.groupBy("spec", "effect").agg(F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n2"), F.count_distinct("cluster").alias("clusters"))
    per = rows.groupBy("_cl", "_g", "tau", "d", "ev").agg(F.count("*").alias("n"))
    both = per.withColumn("b", F.lit(0))
    if draws:
        drawn = stats.multiplicities(rows, ["spec", "effect"], "cluster", draws, seed).select("b", F.concat_ws("|", "spec", "effect", "cluster").alias("_cl"), "freq")
        again = per.join(drawn, "_cl").withColumn("n", F.col("n") * F.col("freq")).drop("freq")
        both = both.unionByName(again)
    both = both.withColumn("_key", F.concat_ws("#", F.col("b").cast("string"), "_g"))
    means = _split(stats.rmst(stats.kaplan_meier(both, "_key", "d", "ev", "n"), both.select("_key", "b", "_g", "tau").distinct(), "tau", "_key", "d"))
    d = staged(means.groupBy("spec", "effect", "b").agg(_difference("rmst").alias("d")))
    est = d.where("b = 0").select("spec", "effect", F.col("d").alias("est"))
    more = _interval(d.where("b > 0")) if draws else _none(est)
    test = stats.robust_log_rank(rows.withColumn("grp", F.col("one").cast("string")), "true", "cluster", by=("spec",)).select("spec", "chi2", "p")
    return n.join(est, ["spec", "effect"]).join(more, ["spec", "effect"], "left").join(test, "spec", "left")


def regression_rows(ev: DataFrame) -> DataFrame:
    """Rows of E2: y, x (the class, or the loss of open interest where the setting is continuous), the logarithm of size
    where the setting has one, and the symbol where there is more than one."""
    used = ev.where(F.col("analysable") & (F.col("continuous") | F.col("klass").isin("contraction", "limited")))
    kinds = used.groupBy("spec").agg((F.min("symbol") < F.max("symbol")).alias("_two"))
    one = F.col("klass") == "contraction"
    rows = used.join(kinds, "spec").select(
        "spec", F.col("short").alias("cluster"), (100 * F.abs("disp")).alias("y"), F.when(F.col("continuous"), -100 * F.col("doi")).otherwise(one.cast("double")).alias("x"),
        F.when(F.col("sized"), F.when(F.col("intensity") > 0, F.log("intensity"))).otherwise(0.0).alias("size"), F.when(F.col("_two"), (F.col("symbol") == "ETH").cast("double")).otherwise(0.0).alias("eth"),
        (2 + F.col("sized").cast("int") + F.col("_two").cast("int")).alias("k"), one.alias("one"),
    )
    return rows.na.drop(subset=["y", "x", "size", "eth"])


XS = ["x", "size", "eth"]


def regression_effect(ev: DataFrame, draws: int, seed: int, at: int = 1) -> DataFrame:
    """E2 of every setting: the coefficient, its CR1 error and p (Student's t by clusters; both null with one cluster, which leaves the coefficient as it is), clusters and effective clusters; with ``draws`` the p and the
    interval of the restricted wild cluster bootstrap. Sums by cluster meet the draws, rows never do."""
    rows = staged(regression_rows(ev))
    names, size = [F.lit(1.0), *map(F.col, XS)], len(XS) + 1
    per = staged(rows.groupBy("spec", "cluster").agg(F.count("*").alias("n"), F.count_if("one").alias("n1"), F.max("k").alias("k"), *linear.sums(rows, [], "y", XS)))
    cells = [linear.cell(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    whole = per.groupBy("spec").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.max("k").alias("k"), F.count("*").alias("g"), *[F.sum(c).alias(c) for c in cells])
    fit = staged(linear.solved(whole, len(XS)))
    v = lambda i, j: F.col(linear.inverse(i, j))
    total = lambda cs: sum(cs, F.lit(0.0))
    met = rows.join(fit.drop("k", "n", "n1", "g"), "spec")
    u = F.col("y") - total(F.col(f"b{i}") * x for i, x in enumerate(names))
    w = total(v(at, i) * x for i, x in enumerate(names))
    by = met.groupBy("spec", "cluster").agg(F.sum(w * u).alias("_s"), F.sum(w).alias("_w"))
    errors = by.groupBy("spec").agg(F.sum(F.col("_s") ** 2).alias("_ss"), F.var_pop(F.col("_w") ** 2).alias("_gv"), F.avg(F.col("_w") ** 2).alias("_gm"))
    c = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - F.col("k"))
    enough = (F.col("g") > 1) & (F.col("n") > F.col("k"))
    out = fit.join(errors, "spec").select(
        "spec", F.lit("E2").alias("effect"), "n1", (F.col("n") - F.col("n1")).alias("n2"), F.col("g").alias("clusters"), F.col(f"b{at}").alias("est"),
        F.when(enough, F.sqrt(c * F.col("_ss"))).alias("se"), (F.col("g") / (1 + F.col("_gv") / F.nullif(F.col("_gm") ** 2, F.lit(0.0)))).alias("g_eff"),
    )
    out = out.withColumn("p_cr1", tails.student_tail(F.col("est") / F.when(F.col("se") > 0, F.col("se")), F.col("clusters") - 1))
    if not draws:
        return out.join(_none(out), ["spec", "effect"]).withColumn("p", F.lit(None).cast("double"))
    return out.join(wild(per, fit, out.select("spec", "se"), draws, seed, at), "spec", "left").withColumn("used", F.lit(draws).cast("bigint"))


def wild(per: DataFrame, fit: DataFrame, errors: DataFrame, draws: int, seed: int, at: int, alpha: float = 0.05) -> DataFrame:
    """(spec, p, lo, hi): the restricted wild cluster bootstrap of coefficient ``at`` in every setting.

    A cluster's scores are linear in the null's distance from the estimate, so five sums a draw give t of every null. The
    interval's ends are found from a setting's draws alone, one group of ``draws`` rows each."""
    size = len(XS) + 1
    total = lambda cs: sum(cs, F.lit(0.0))
    a = lambda i, j: F.col(linear.cell(i, j))
    v = lambda i, j: F.col(linear.inverse(i, j))
    t = per.join(fit.select("spec", *[f"b{i}" for i in range(size)], *[linear.inverse(i, j) for i in range(size) for j in range(i, size)]), "spec")
    t = t.withColumns({f"s{i}": a(i, size) - total(a(i, j) * F.col(f"b{j}") for j in range(size)) for i in range(size)} | {f"z{i}": -total(a(i, j) * v(at, j) / v(at, at) for j in range(size)) for i in range(size)})
    t = staged(t.where(F.col(f"b{at}").isNotNull()))
    obs = t.groupBy("spec").agg(F.sqrt(F.sum(total(v(at, i) * F.col(f"s{i}") for i in range(size)) ** 2)).alias("spread"), F.max(f"b{at}").alias("est"))
    six = F.array(*[F.lit(x) for x in (-(1.5**0.5), -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5)])
    dealt = t.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("v", F.element_at(six, (stats.draw(seed, F.col("b"), F.col("cluster")) % 6 + 1).cast("int")))
    shift = dealt.groupBy("spec", "b").agg(*[F.sum(F.col("v") * F.col(f"{x}{i}")).alias(f"t{x}{i}") for x in "sz" for i in range(size)])
    joined = dealt.join(shift, ["spec", "b"])
    moved = {f"d{x}{i}": total(v(i, j) * F.col(f"t{x}{j}") for j in range(size)) for x in "sz" for i in range(size)}
    joined = joined.withColumns(moved)
    score = lambda x: total(v(at, i) * (F.col("v") * F.col(f"{x}{i}") - total(a(i, j) * F.col(f"d{x}{j}") for j in range(size))) for i in range(size))
    scores = joined.select("spec", "b", F.col(f"ds{at}").alias("d0"), F.col(f"dz{at}").alias("d1"), score("s").alias("p"), score("z").alias("q"))
    sums = scores.groupBy("spec", "b").agg(F.max("d0").alias("d0"), F.max("d1").alias("d1"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("q") ** 2).alias("qq"))
    sums = sums.join(obs, "spec").join(errors, "spec")

    def ends(group: pa.Table) -> pa.Table:
        d0, d1, pp, pq, qq = (group[c].to_numpy() for c in ("d0", "d1", "pp", "pq", "qq"))
        est, spread, se = (group[c][0].as_py() for c in ("est", "spread", "se"))

        def kept(null: float) -> float:
            x = null - est
            with np.errstate(divide="ignore", invalid="ignore"):
                return float(np.mean(np.abs(d0 + x * d1) / np.sqrt(pp + 2 * x * pq + x * x * qq) >= abs(x) / spread))

        def end(side: int) -> float | None:
            inner, outer, step = est, est + side * se, se
            for _ in range(60):
                if kept(outer) <= alpha:
                    break
                inner, step = outer, 2 * step
                outer = est + side * step
            else:
                return None
            for _ in range(40):
                middle = (inner + outer) / 2
                inner, outer = (middle, outer) if kept(middle) > alpha else (inner, middle)
            return (inner + outer) / 2

        known = bool(se) and bool(spread)
        return pa.table({"spec": group["spec"].slice(0, 1), "p": pa.array([kept(0.0) if known else None], pa.float64()), "lo": pa.array([end(-1) if known else None], pa.float64()), "hi": pa.array([end(1) if known else None], pa.float64())})

    return sums.groupBy("spec").applyInArrow(ends, "spec string, p double, lo double, hi double")


@tidied
def effects(ev: DataFrame, draws: int = 0, wild_draws: int = 0, seed: int = 11) -> DataFrame:
    """(spec, effect, n1, n2, clusters, est, lo, hi, p, used, p_cr1, g_eff, chi2): a row an effect of every setting that has
    contrast rows.

    Estimates and intervals are null where a class has fewer than three events with a value, or fewer than three at
    all; a setting whose regression is continuous needs both classes too. p: of E2 the bootstrap's, of E6 the robust
    log-rank test's, whose chi2 is beside it; p_cr1 and g_eff are E2's. ``used``: draws in which both classes occurred."""
    ev = staged(ev)
    c = contrast(ev)
    met = None
    for one in (median_effects(c, draws, seed), recovery_effect(c, draws, seed), regression_effect(ev, wild_draws, seed)):
        one = one.select(*[F.col(c) if c in one.columns else F.lit(None).cast("double").alias(c) for c in COLUMNS])
        met = one if met is None else met.unionByName(one)
    classes = c.groupBy("spec").agg(F.count_if("one").alias("_a"), F.count_if(~F.col("one")).alias("_b"))
    own = (F.col("effect") == "E2") | (F.least("n1", "n2") >= LEAST)
    ok = own & (F.least("_a", "_b") >= LEAST)
    return met.join(classes, "spec").select(*[F.when(ok, F.col(c)).alias(c) if c in ("est", "lo", "hi", "p", "p_cr1", "g_eff", "chi2") else c for c in COLUMNS])


def flat(found: DataFrame, short: DataFrame, long: DataFrame, analysable: DataFrame) -> DataFrame:
    """One row a setting: counts, clusters, and est, lo and hi of every effect; of the regression both p, clusters and
    effective clusters, of recovery the robust log-rank's p."""
    of = lambda e, c: F.max(F.when(F.col("effect") == e, F.col(c))).alias(f"{e.lower()}_{c}")
    wide = found.groupBy("spec").agg(*[of(e, c) for e in ("E1", "E2", "E3", "E4", "E5", "E6") for c in ("est", "lo", "hi")], of("E2", "p"), of("E2", "p_cr1"), of("E2", "clusters"), of("E2", "g_eff"), of("E6", "p"))
    counts = short.select("spec", F.col("n1").alias("n_contraction"), F.col("n2").alias("n_limited"), F.col("g").alias("g_short"), F.col("g_mixed").alias("g_short_mixed"))
    return counts.join(long.select("spec", F.col("g").alias("g_long")), "spec").join(analysable, "spec").join(wide, "spec", "left")


def verdicts(found: DataFrame, before: dict[str, int]) -> DataFrame:
    """(spec, effect, est, lo, hi, verdict): the sign against the one ``before``, and whether the interval excludes zero."""
    old = F.coalesce(*[F.when(F.col("effect") == k, F.lit(v)) for k, v in before.items()])
    beyond = F.coalesce(((F.col("lo") > 0) & (old > 0)) | ((F.col("hi") < 0) & (old < 0)), F.lit(False))
    # fixed values: the texts of the verdicts
    verdict = F.when(F.col("est").isNull() | old.isNull(), "n/a").when(F.signum("est") != old, "Not supported (opposite sign)").when(beyond, "Supported (exploratory)").otherwise("Directionally consistent, imprecise")
    return found.select("spec", "effect", "est", "lo", "hi", verdict.alias("verdict"))

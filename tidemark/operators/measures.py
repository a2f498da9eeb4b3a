"""Per-onset measures: reference price, displacement, open interest, persistence, first passage, classes.

Onsets carry their own window (``WINDOW`` columns), so onsets of several settings are measured in one plan. All that
comes from bars is one range join and windows over the bars of an onset; open interest is another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import MINUTE, Study
from ..storage import staged
from .lookups import in_range

M = MINUTE
#: Columns that hold an onset's window: minutes before and after it, and the first and last reference bar before it.
WINDOW = ("before_min", "after_min", "ref_from", "ref_to")
HOURS = (6, 24)


def still(column: str | Column) -> Column:
    """The mean, exact where all values are equal: a price that did not move then leaves no rounding noise behind."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.avg(column))


def ordered_mean(column: str | Column, order: str | Column) -> Column:
    """The mean of a few values, summed by ascending ``order``: equal values give equal bits however rows were shuffled.

    Classes compare a response with a quantile of earlier ones, and a pattern that returns meets itself there; with
    ``F.avg`` the order in which rows arrive would decide such ties."""
    value = F.col(column) if isinstance(column, str) else column
    order = F.col(order) if isinstance(order, str) else order
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("v")))))
    return F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["v"]) / F.size(listed))


def windowed(ev: DataFrame, p: Study) -> DataFrame:
    """``ev`` with the study's window in every row."""
    values = (p.window.before_min, p.window.after_min, *p.window.reference)
    return ev.withColumns({name: F.lit(v).cast("bigint") for name, v in zip(WINDOW, values)})


def _ago(name: str) -> Column:
    return F.col("e0") - F.col(name) * M


def from_bars(ev: DataFrame, bars: DataFrame, p: Study, keys: tuple[str, ...]) -> DataFrame:
    """Onsets with reference price, displacement, persistence and the three first passages.

    One range join of onsets with the bars from their reference to their horizon (some 300 an onset); windows over an
    onset's bars find the reference and the trough, mark the bars before the first gap of each follow-up, and one
    aggregate takes all measures."""
    width, horizon, e0 = p.clock.width_min * M, p.outcome.horizon_h * 60 * M, F.col("e0")
    ends = bars.groupBy("symbol").agg(F.max("bar_end").alias("data_end"))
    ev = ev.join(ends, "symbol")
    post = e0 + F.col("after_min") * M
    need = F.floor((F.col("before_min") + F.col("after_min")) / p.clock.width_min) - p.window.missing_bars
    reach = max(horizon, *[h * 60 * M for h in HOURS])
    near = in_range(ev.select(*keys, *WINDOW, "data_end"), bars.select("symbol", "bar", "bar_end", "close", "low", "high"), F.least(_ago("before_min"), _ago("ref_from")), F.greatest(e0 + reach, post), time="bar")
    bar, end, all_bars = F.col("bar"), F.col("bar_end"), Window.partitionBy(*keys)
    ref = F.when(bar.between(_ago("ref_from"), _ago("ref_to")), F.col("close"))
    low = F.when(bar.between(_ago("before_min"), post - width) & F.col("low").isNotNull(), F.struct("low", "bar"))
    over = lambda f: f.over(all_bars)
    near = near.withColumns({"ref_bars": over(F.count(ref)), "w_bars": over(F.count(low)), "_least": over(F.min(low)), "_mean": F.when(over(F.min(ref)) == over(F.max(ref)), over(F.min(ref))).otherwise(over(F.avg(ref)))})
    near = near.withColumn("p_ref", F.when(F.col("ref_bars") >= p.window.reference_bars, F.col("_mean"))).withColumn("w_ok", (F.col("w_bars") >= need) & (post <= F.col("data_end")))
    near = near.withColumn("trough", F.when(F.col("w_ok") & F.col("p_ref").isNotNull(), F.col("_least.bar")))
    ordered = Window.partitionBy(*keys).orderBy("bar_end")
    near = near.withColumn("_prev", F.lag("bar_end").over(ordered))
    stop, starts = e0 + horizon, {"post": post, "trough": F.col("trough") + width}
    for name, start in starts.items():
        inside = (end > start) & (end <= stop)
        gap = end - F.greatest(F.coalesce("_prev", start), start)
        broken = F.sum((inside & (gap > p.outcome.gap_min * M)).cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        near = near.withColumn(f"_in_{name}", inside & (broken == 0))
    level = F.col("p_ref") * (1 - p.outcome.tolerance)
    first = lambda where, column: F.min(F.when(F.col(where) & (F.col(column) >= level), end))
    last = lambda where: F.max(F.when(F.col(where), end))
    at = lambda h: e0 + h * 60 * M
    fresh = lambda h: F.max_by("close", F.when(end.between(at(h) - p.outcome.age_min * M, at(h)), end))
    met = near.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("ref_bars", "w_bars", "p_ref", "trough")], F.max("_least.low").alias("_low"), *[fresh(h).alias(f"_p{h}") for h in HOURS],
        first("_in_post", "close").alias("_hit_rec"), last("_in_post").alias("_fu_post"), last("_in_trough").alias("_fu_trough"),
        first("_in_trough", "close").alias("_hit_rec_trough_close"), first("_in_trough", "high").alias("_hit_rec_trough_high"),
    )
    out = ev.join(met, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ref_bars", "w_bars")})
    out = out.withColumn("w_ok", (F.col("w_bars") >= need) & (post <= F.col("data_end")))
    out = out.withColumn("disp", F.when(F.col("trough").isNotNull(), F.log(F.col("_low") / F.col("p_ref"))))
    out = out.withColumns({f"p{h}h": F.when(at(h) <= F.col("data_end"), F.log(F.col(f"_p{h}") / F.col("p_ref"))) for h in HOURS})
    for prefix, seg, origin in (("rec", "post", post), ("rec_trough_close", "trough", e0), ("rec_trough_high", "trough", e0)):
        hit, start = F.col(f"_hit_{prefix}"), starts[seg]
        some, until = F.col("p_ref").isNotNull() & start.isNotNull(), F.coalesce(f"_fu_{seg}", start)
        out = out.withColumns({
            f"{prefix}_min": F.when(some, F.greatest(F.lit(0.0), (F.coalesce(hit, until) - origin) / M)),
            f"{prefix}_event": F.when(some, hit.isNotNull()),
            f"{prefix}_complete": F.when(some, hit.isNotNull() | (until >= stop)),
        })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def from_interest(ev: DataFrame, snaps: DataFrame, p: Study, keys: tuple[str, ...]) -> DataFrame:
    """(keys, oi_base_n, oi_trough_n, base_ok, trough_ok, doi): trough over baseline mean of open interest as of five-minute
    points. A snapshot serves the points that follow it within its largest age; the last one of each point counts."""
    step, stale, e0 = p.clock.width_min * M, int(p.interest.stale_min * M), F.col("e0")
    if p.interest.base_min % p.clock.width_min:
        raise ValueError("the baseline is a whole number of steps")
    origin, last = _ago("before_min"), e0 + F.col("after_min") * M
    first = origin - p.interest.base_min * M
    near = in_range(ev.select(*keys, "before_min", "after_min"), snaps.select("symbol", "t", "oi", *[c for c in ("ingest_idx",) if c in snaps.columns]), first - stale, last, time="t")
    t = F.col("t")
    from_, to = origin + F.ceil((t - origin) / step) * step, origin + F.floor((t + stale - origin) / step) * step
    served = near.where(from_ <= to).withColumn("g", F.explode(F.sequence(from_, to, F.lit(step)))).where(F.col("g").between(first, last))
    latest = served.groupBy(*keys, "before_min", "g").agg(F.max_by("oi", F.struct("t", *[c for c in ("ingest_idx",) if c in snaps.columns])).alias("oi"))
    base, trough = F.when(F.col("g") <= origin, F.col("oi")), F.when(F.col("g") > origin, F.col("oi"))
    met = latest.groupBy(*keys).agg(F.count(base).alias("oi_base_n"), F.count(trough).alias("oi_trough_n"), ordered_mean(base, "g").alias("_b"), F.min(trough).alias("_t"))
    out = ev.select(*keys, "before_min", "after_min").join(met, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("oi_base_n", "oi_trough_n")})
    n_base, n_trough = p.interest.base_min // p.clock.width_min + 1, F.floor((F.col("before_min") + F.col("after_min")) / p.clock.width_min)
    out = out.withColumn("base_ok", F.col("oi_base_n") >= n_base - p.interest.base_missing).withColumn("trough_ok", F.col("oi_trough_n") >= n_trough - p.interest.trough_missing)
    return out.withColumn("doi", F.when(F.col("base_ok") & F.col("trough_ok"), (F.col("_t") - F.col("_b")) / F.col("_b"))).drop("_b", "_t", "before_min", "after_min")


def reasons(ev: DataFrame) -> DataFrame:
    # fixed values: the texts of the reasons
    parts = [F.when(F.col("p_ref").isNull(), "reference_bars"), F.when(~F.col("w_ok"), "window_bars_or_beyond_data"), F.when(~F.col("base_ok"), "oi_baseline"), F.when(~F.col("trough_ok"), "oi_trough")]
    return ev.withColumn("reason", F.concat_ws(";", *parts))


def classify(ev: DataFrame, p: Study, labels: tuple[str, str, str, str] = ("contraction", "intermediate", "limited", "unknown"), by: tuple[str, ...] = ("symbol",), fixed: Column | None = None) -> DataFrame:
    """Classes by the quantile of the symbol's earlier responses; unknown rows are no priors. ``fixed``: rows whose class
    has the fixed cut instead."""
    w = Window.partitionBy(*by).orderBy("e0").rowsBetween(Window.unboundedPreceding, -1)
    doi = F.col("doi")
    fixed = F.lit(p.classes.rule == "fixed") if fixed is None else fixed
    moving = F.when(F.count("doi").over(w) >= p.classes.least_prior, F.expr(f"percentile(doi, {p.classes.share}D)").over(w)).otherwise(F.lit(p.classes.cut))
    out = ev.withColumn("contraction_cut", F.when(doi.isNotNull(), F.when(fixed, F.lit(p.classes.cut)).otherwise(moving)))
    return out.withColumn("klass", F.when(doi.isNull(), labels[3]).when(doi <= F.col("contraction_cut"), labels[0]).when(doi > p.classes.upper, labels[2]).otherwise(labels[1]))


def reversion(ev: DataFrame) -> DataFrame:
    ok = F.col("p6h").isNotNull() & (F.col("disp") != 0)
    return ev.withColumn("reversion", F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("p6h") / F.col("disp")))))


def intensity(ev: DataFrame, p: Study) -> DataFrame:
    value = {"onset": F.col("r_onset"), "window_total": F.col("notional_w")}.get(p.classes.size, F.lit(None).cast("double"))
    return ev.withColumn("intensity", value).withColumn("analysable", (F.col("reason") == "") & (F.col("klass") != "unknown"))


def all_measures(ev: DataFrame, bars: DataFrame, snaps: DataFrame, p: Study, keys: tuple[str, ...] = ("symbol", "e0")) -> DataFrame:
    """Staged onsets with everything that does not depend on classes: two range joins, side by side."""
    return reasons(from_bars(ev, bars, p, keys).join(from_interest(ev, snaps, p, keys), list(keys)))


def measured(ev: DataFrame, bars: DataFrame, snaps: DataFrame, p: Study) -> DataFrame:
    """All measures of one study, over all symbols at once."""
    out = all_measures(staged(windowed(ev, p)), bars, snaps, p).drop(*WINDOW)
    return intensity(reversion(classify(out, p)), p)

"""The declared sensitivity grid: all settings through one plan, told apart by a ``spec`` column.

Bins of every feed share one ordered trail that answers all quantiles; triggers are dealt to clocks (feed, quantile,
warm-up, quiet period) and chained by clock; the union of all onsets is measured once for every window; classes
follow by build (clock, window, rule) and settings by what they keep, regress on and count as recovery."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clock, measures
from ..params import DAY, MINUTE, Study
from ..storage import discard, staged, tidied
from . import study


@dataclass(frozen=True)
class Spec:
    """One setting: its study, the fills it reads, the passage that counts as recovery, the events it keeps (SQL over symbol
    and e0), and whether the regression is on the loss of open interest itself."""

    name: str
    study: Study = field(default_factory=Study)
    feed: str = "base"
    passage: str = "rec"
    keep: str = "true"
    continuous: bool = False
    clear_of_runs: bool = False

    @property
    def clock(self) -> tuple:
        c = self.study.clock
        return ("masked" if c.masked_run_h else self.feed, c.quantile, c.warmup_days, c.quiet_min)

    @property
    def window(self) -> tuple:
        w = self.study.window
        return (w.before_min, w.after_min, *w.reference)

    @property
    def build(self) -> tuple:
        return (self.clock, self.window, self.study.classes.rule)

    @property
    def tau(self) -> float:
        """Minutes of follow-up: from the window's end, or from the onset for passages after the trough."""
        horizon = self.study.outcome.horizon_h * 60
        return float(horizon - self.study.window.after_min if self.passage == "rec" else horizon)


def declared(p: Study, left_out: tuple[int, int], short_warmup: int = 7, masked_h: float = 12.0) -> list[Spec]:
    """The nineteen settings; ``left_out``: the times (from, before) that S10 excludes."""
    return [
        Spec("Primary", p),
        Spec("S1", p.but(warmup_days=short_warmup)),
        Spec("S2", p.but(quantile=0.95)),
        Spec("S3", p.but(reference=(35, 10))),
        Spec("S4", p.but(rule="fixed")),
        Spec("S5a", p.but(size="window_total")),
        Spec("S5b", p.but(size="none")),
        Spec("S13a", p.but(quiet_min=60)),
        Spec("S13b", p.but(quiet_min=180)),
        Spec("S13c", p.but(after_min=60)),
        Spec("S13d", p.but(after_min=180)),
        Spec("S6a", p, passage="rec_trough_close"),
        Spec("S6b", p, passage="rec_trough_high"),
        Spec("S8", p.but(masked_run_h=masked_h), clear_of_runs=True),
        Spec("S9", p, feed="reinstated"),
        Spec("S10", p, keep=f"not (e0 >= {left_out[0]} and e0 < {left_out[1]})"),
        Spec("S11a", p, keep="symbol = 'BTC'"),
        Spec("S11b", p, keep="symbol = 'ETH'"),
        Spec("S12", p, continuous=True),
    ]


def _ids(values: list[tuple]) -> dict[tuple, int]:
    return {v: i for i, v in enumerate(dict.fromkeys(values))}


def _choose(column: str, of: dict[int, list[Column]]) -> Column:
    """An array of structs by the number in ``column``, to be exploded."""
    out = None
    for number, structs in of.items():
        at = F.array(*structs)
        out = F.when(F.col(column) == number, at) if out is None else out.when(F.col(column) == number, at)
    return out


def table(feeds: dict[str, DataFrame], specs: list[Spec], runs: DataFrame | None) -> DataFrame:
    """(symbol, e, notional, r, thr, first): bins of every feed; symbol has the feed before it, thr a value a quantile."""
    p = specs[0].study
    wanted = {s.clock[0] for s in specs}
    plain = staged(clock.bins(feeds["base"], p))
    parts = {"base": plain, "masked": clock.mask_runs(plain, runs) if "masked" in wanted else None}
    parts |= {name: clock.bins(f, p) for name, f in feeds.items() if name != "base" and name in wanted}
    b = None
    for name in sorted(wanted):
        one = parts[name].select(F.concat_ws(":", F.lit(name), "symbol").alias("symbol"), "e", "notional")
        b = one if b is None else b.unionByName(one)
    quantiles = tuple(dict.fromkeys(s.clock[1] for s in specs))
    b = staged(b)
    t = clock.thresholds(clock.rolled(b, p), p, quantiles=quantiles)
    out = staged(t.join(b.groupBy("symbol").agg(F.min("e").alias("first")), "symbol"))
    discard(plain, b)
    return out


def fired(t: DataFrame, specs: list[Spec]) -> DataFrame:
    """(clock, symbol, e, r, thr, quiet): the triggers of every clock."""
    p = specs[0].study
    quantiles = list(dict.fromkeys(s.clock[1] for s in specs))
    cases = []
    for (feed, q, warm, quiet), i in _ids([s.clock for s in specs]).items():
        thr = F.element_at("thr", quantiles.index(q) + 1)
        since = F.col("first") + (p.clock.span_bins - 1) * p.clock.width_min * MINUTE + warm * DAY
        hit = F.startswith("symbol", F.lit(f"{feed}:")) & (F.col("e") >= since) & (F.col("r") > 0) & (F.col("r") >= thr)
        cases.append(F.when(hit, F.struct(F.lit(i).alias("clock"), F.lit(quiet).alias("quiet"), thr.alias("cut"))))
    met = F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")
    return t.where(F.col("r") > 0).select("symbol", "e", "r", met).select("x.clock", "symbol", "e", "r", F.col("x.cut").alias("thr"), "x.quiet")


@tidied
def events(feeds: dict[str, DataFrame], bars: DataFrame, snaps: DataFrame, specs: list[Spec]) -> DataFrame:
    """Event tables of all settings as one, with the columns that ``effects`` asks for. ``feeds``: fills by name.

    The settings share bins, trails, windows' spans, outcomes and interest; they may differ in what ``Spec`` keys by."""
    p = specs[0].study
    masked = next((s.study.clock.masked_run_h for s in specs if s.study.clock.masked_run_h), None)
    runs = staged(clock.zero_runs(feeds["base"], p, masked)) if masked else None
    t = table(feeds, specs, runs)
    clocks, windows, builds = _ids([s.clock for s in specs]), _ids([s.window for s in specs]), _ids([s.build for s in specs])
    chained = clock.chained(fired(t, specs), p, by=["clock", "symbol"], quiet=F.col("quiet"))
    chains = clock.chains(chained, by=("clock", "symbol"))
    spans = {}
    for s in specs:
        spans.setdefault(clocks[s.clock], {})[windows[s.window]] = F.struct(F.lit(windows[s.window]).alias("win"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip(measures.WINDOW, s.window)])
    ev = chains.withColumn("_w", F.explode(_choose("clock", {c: list(w.values()) for c, w in spans.items()}))).select("*", "_w.*").drop("_w")
    ev = staged(clock.enriched(ev, t, ("clock", "win", "symbol", "e0")).withColumn("symbol", F.substring_index("symbol", ":", -1)))
    keys = ["win", "symbol", "e0"]
    union = staged(ev.select(*keys, *measures.WINDOW).distinct())
    met = measures.all_measures(union, bars, snaps, p, tuple(keys)).drop(*measures.WINDOW)
    rules = {}
    for s in specs:
        rules.setdefault((clocks[s.clock], windows[s.window]), {})[builds[s.build]] = F.struct(F.lit(builds[s.build]).alias("build"), F.lit(s.study.classes.rule == "fixed").alias("_fixed"))
    pair = {c * len(windows) + w: list(r.values()) for (c, w), r in rules.items()}
    dealt = ev.withColumn("_pair", F.col("clock") * len(windows) + F.col("win")).withColumn("_r", F.explode(_choose("_pair", pair))).select("*", "_r.*").drop("_r", "_pair")
    classed = measures.reversion(measures.classify(dealt.join(met, keys), p, by=("build", "symbol"), fixed=F.col("_fixed")))
    classed = staged(study.overlapping(classed, runs, p, ("build", "symbol", "e0")) if runs is not None else classed.withColumn("overlaps", F.lit(False)))
    settings = {}
    for s in specs:
        size = {"onset": F.col("r_onset"), "window_total": F.col("notional_w")}.get(s.study.classes.size, F.lit(None).cast("double"))
        there = (F.col("reason") == "") & (F.col("klass") != "unknown")
        one = F.struct(
            F.lit(s.name).alias("spec"), size.alias("intensity"), F.lit(s.study.classes.size != "none").alias("sized"), F.lit(s.continuous).alias("continuous"), F.lit(s.tau).alias("tau"),
            *[F.col(f"{s.passage}_{c}").alias(f"now_{c}") for c in ("min", "event")], (there & ~F.col("overlaps") if s.clear_of_runs else there).alias("analysable"),
        )
        settings.setdefault(builds[s.build], []).append(F.when(F.expr(s.keep), one))
    rows = classed.withColumn("_s", F.explode(_choose("build", settings))).where("_s is not null").select("_s.*", "symbol", "e0", "klass", "disp", "doi", "p6h", "p24h", "reversion")
    rows = rows.withColumnsRenamed({"now_min": "rec_min", "now_event": "rec_event"})
    out = study.clustered(rows, ("spec",)).withColumn("short", F.col("ep6").cast("string")).withColumn("long", F.col("ep24").cast("string"))
    return out


@tidied
def onset_counts(feeds: dict[str, DataFrame], specs: list[Spec]) -> DataFrame:
    """(spec, symbol, onsets) of settings that need no measures: one trail, one pass over the triggers of all clocks."""
    clocks, names = _ids([s.clock for s in specs]), {}
    for s in specs:
        names.setdefault(clocks[s.clock], []).append(F.lit(s.name))
    new = clock.chained(fired(table(feeds, specs, None), specs), specs[0].study, by=["clock", "symbol"], quiet=F.col("quiet")).where("new")
    per = new.groupBy("clock", F.substring_index("symbol", ":", -1).alias("symbol")).agg(F.count("*").alias("onsets"))
    return per.select(F.explode(_choose("clock", names)).alias("spec"), "symbol", "onsets")


#: Pairs of cluster columns, short and long, that the clustering sensitivity compares.
CLUSTERINGS = (("ep6/ep24", "ep6", "ep24"), ("ep24/ep24", "ep24", "ep24"), ("ep6/ep6", "ep6", "ep6"), ("day/day", "day", "day"), ("week/week", "week", "week"), ("none/none", "none", "none"))


def clusterings(ev: DataFrame) -> DataFrame:
    """Every event once for each pair of cluster columns, the pair as ``spec``: the effects engine then compares them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("spec"), F.col(a).cast("string").alias("short"), F.col(b).cast("string").alias("long")) for name, a, b in CLUSTERINGS])).alias("x")
    return ev.drop("spec", "short", "long").select("*", pairs).select("*", "x.*").drop("x")

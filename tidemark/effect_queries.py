"""Registered queries over effects: the primary study, the declared grid, clusterings, the superseded definitions.

Open interest comes from the adapter whose swings alternate (``calm``), so that both classes occur at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BARS, COV, DENSE, FILLS, LOUT, MEAS, ZERO, D, M, OTHER, P, W, both_sql, calm, chi_square_sql, query, student_sql, trig_sql
from .operators import quality
from .params import Study
from .plans import audit, effects, grid, study, superseded
from .sources import driver_tables as src
from .storage import staged

SIGNS = {"E1": -1, "E2": 1, "E3": -1, "E4": -1, "E5": -1, "E6": 1}
#: Draws of the registered queries with intervals: those of the reference for one study, its quick mode for grids.
DRAWS, WILD, QUICK, QUICK_WILD = 4999, 9999, 499, 999
SHORT_WARMUP, MASKED_H = 3, 1.0


# ---- event tables


def left_out(kept: DataFrame) -> tuple[int, int]:
    first = src.coverage(kept).agg(F.min("c0")).first()[0]
    return first + 10 * D, first + 18 * D


def grid_events(spark, d, names: tuple[str, ...] | None = None) -> DataFrame:
    """Events of the declared settings. The rows of one direction count as lost, which S9 puts back."""
    kept = src.fills(spark, d).where("direction <> 'Close Short'")
    specs = [s for s in grid.declared(P, left_out(kept), SHORT_WARMUP, MASKED_H) if names is None or s.name in names]
    feeds = {"base": kept}
    if any(s.feed == "reinstated" for s in specs):
        feeds["reinstated"] = staged(quality.reinstated(kept, quality.dropped(kept)))
    snaps = staged(src.dense(spark, d, calm=True))
    return staged(grid.events(feeds, staged(src.bars(snaps)), snaps, specs))


LOST = f"all_{FILLS}, gp AS (SELECT *, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n_lost FROM all_fills WHERE direction <> 'Close Short')"
FEEDS = {
    "base": f"{LOST}, fills AS (SELECT * EXCLUDE (n_lost) FROM gp)",
    "reinstated": f"{LOST}, fills AS (SELECT * EXCLUDE (n_lost) FROM gp UNION ALL SELECT * EXCLUDE (n_lost, i) FROM (SELECT *, unnest(range(n_lost)) AS i FROM gp WHERE n_lost > 0))",
}
RUNS = ZERO[len(COV) + 2 :].replace("grid AS", "grid2 AS").replace("FROM grid g", "FROM grid2 g").replace("bins AS", "bins2 AS").replace("FROM bins", "FROM bins2")
SNAPS = ", cov2 AS (SELECT symbol, min(t) // {D} * {D} AS c0, max(t) // {D} * {D} + {D} AS c1 FROM all_fills GROUP BY symbol)".replace("{D}", str(D)) + ", " + DENSE[len(COV) + 2 :].replace("FROM cov", "FROM cov2").replace("FROM fills", "FROM all_fills") + ", " + BARS
TAIL = MEAS[len(both_sql()) :]


def swap(sql: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


def events_sql(s: grid.Spec) -> str:
    """The events of one setting."""
    c, w, size = s.study.clock, s.study.window, s.study.classes.size
    feed, q, warm, quiet = s.clock
    trig = swap(trig_sql(q, quiet)[len(FILLS) :], {f"+ {2 * W + 7 * D} AS from_e": f"+ {2 * W + warm * D} AS from_e"})
    if c.masked_run_h:
        trig = trig.replace("bins AS (SELECT", "bins0 AS (SELECT", 1).replace(", roll AS", f", {RUNS}, long_runs AS (SELECT * FROM runs WHERE hours >= {c.masked_run_h}), bins AS (SELECT b.symbol, b.e, CASE WHEN EXISTS (SELECT 1 FROM long_runs s WHERE s.symbol = b.symbol AND b.e > s.run_start AND b.e <= s.run_end) THEN NULL ELSE notional END AS notional, n FROM bins0 b), roll AS", 1)
    n = (w.before_min + w.after_min) // 5
    tail = swap(TAIL, {f"{45 * M} AND": f"{w.reference[0] * M} AND", f"o.e0 - {20 * M}": f"o.e0 - {w.reference[1] * M}", f"+ {115 * M}": f"+ {(w.after_min - 5) * M}", "w_bars >= 25": f"w_bars >= {n - 2}", "oi_trough_n >= 24": f"oi_trough_n >= {n - 3}", "oi_trough_n < 24": f"oi_trough_n < {n - 3}", f"+ {120 * M}": f"+ {w.after_min * M}", f"- {120 * M}": f"- {w.after_min * M}"})
    if s.study.classes.rule == "fixed":
        tail = swap(tail, {"CASE WHEN n_prior >= 20 THEN q ELSE -0.025 END": "-0.025"})
    rec, more = "rec_min, rec_event", ""
    if s.passage != "rec":
        more, rec = f", {OTHER}", f"(SELECT {s.passage}_min FROM m7 WHERE m7.symbol = f.symbol AND m7.e0 = f.e0) AS rec_min, (SELECT {s.passage}_event FROM m7 WHERE m7.symbol = f.symbol AND m7.e0 = f.e0) AS rec_event"
    intensity = {"onset": "r_onset", "window_total": f"(SELECT sum(notional) FROM trig t WHERE t.symbol = f.symbol AND t.e > f.e0 - {15 * M} AND t.e <= f.e0 + {w.after_min * M})", "none": "NULL::double"}[size]
    clear = f" AND NOT EXISTS (SELECT 1 FROM long_runs x WHERE x.symbol = f.symbol AND x.run_start < f.e0 + {w.after_min * M} AND x.run_end > f.e0 - {w.before_min * M})" if s.clear_of_runs else ""
    feed = FEEDS["reinstated" if s.feed == "reinstated" else "base"]
    return calm(f"SELECT * FROM (WITH {feed}{trig}{SNAPS}{tail}{more} SELECT '{s.name}' AS spec, symbol, e0, klass, analysable{clear} AS analysable, disp, doi, p6h, p24h, reversion, {rec}, {intensity} AS intensity, {str(size != 'none').lower()} AS sized, {str(s.continuous).lower()} AS continuous, {s.tau} AS tau FROM fin f WHERE {s.keep})")


def effects_sql(ev: str) -> str:
    """Estimates of the six effects over the CTE ``ev`` with short and long."""
    cells = " UNION ALL ".join(f"SELECT spec, '{e}' AS effect, one, {'long' if far else 'short'} AS cl, {m} * {k} AS v FROM cx" for e, m, k, far in effects.MEDIANS)
    centred = lambda cols: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY spec) AS {c}" for c in cols)
    without = lambda z, cols: ", ".join(f"{c} - {z} * coalesce(sum({c} * {z}) OVER w / nullif(sum({z} * {z}) OVER w, 0), 0) AS {c}" for c in cols)
    return f"""{ev}, cx AS (SELECT *, klass = 'contraction' AS one FROM ev WHERE analysable AND klass IN ('contraction', 'limited')),
cells AS (SELECT * FROM ({cells}) WHERE v IS NOT NULL),
med AS (SELECT spec, effect, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, count(DISTINCT cl) AS clusters, quantile_cont(v, 0.5) FILTER (one) - quantile_cont(v, 0.5) FILTER (NOT one) AS est, NULL::double AS chi2, NULL::double AS p_cr1, NULL::double AS g_eff FROM cells GROUP BY 1, 2),
rc AS (SELECT spec, one, long AS cl, rec_min AS d, rec_event AS ev, tau FROM cx WHERE rec_min IS NOT NULL),
kp AS (SELECT spec, one, tau, d, count(*) AS n, count(*) FILTER (ev) AS deaths FROM rc GROUP BY 1, 2, 3, 4),
ka AS (SELECT *, sum(n) OVER (PARTITION BY spec, one ORDER BY d DESC) AS at_risk FROM kp),
km AS (SELECT spec, one, tau, d, product(1 - deaths / at_risk) OVER (PARTITION BY spec, one ORDER BY d) AS s FROM ka WHERE deaths > 0),
ks AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY spec, one ORDER BY d), tau) AS nx FROM km WHERE d < tau),
kr AS (SELECT g.spec, g.one, coalesce(any_value(a.a), any_value(g.tau)) AS rmst FROM (SELECT DISTINCT spec, one, tau FROM rc) g LEFT JOIN (SELECT spec, one, min(d) + sum(s * (nx - d)) AS a FROM ks GROUP BY 1, 2) a USING (spec, one) GROUP BY 1, 2),
lt AS (SELECT spec, d, count(*) AS n_at, count(*) FILTER (one) AS n1_at, count(*) FILTER (ev) AS dd FROM rc GROUP BY 1, 2),
lu AS (SELECT *, sum(n_at) OVER dn AS n, sum(n1_at) OVER dn / sum(n_at) OVER dn AS zbar FROM lt WINDOW dn AS (PARTITION BY spec ORDER BY d DESC)),
lv AS (SELECT *, sum(dd / n) OVER up AS h, sum(dd / n * zbar) OVER up AS hz FROM lu WINDOW up AS (PARTITION BY spec ORDER BY d)),
lw AS (SELECT spec, cl, sum(CASE WHEN ev THEN one::int - zbar ELSE 0 END - (one::int * h - hz)) AS w FROM rc JOIN lv USING (spec, d) GROUP BY 1, 2),
lx AS (SELECT spec, sum(w) * sum(w) / nullif(sum(w * w), 0) AS chi2 FROM lw GROUP BY 1),
e6 AS (SELECT spec, 'E6' AS effect, (SELECT count(*) FROM rc r WHERE r.spec = k.spec AND one) AS n1, (SELECT count(*) FROM rc r WHERE r.spec = k.spec AND NOT one) AS n2, (SELECT count(DISTINCT cl) FROM rc r WHERE r.spec = k.spec) AS clusters, max(rmst) FILTER (one) - max(rmst) FILTER (NOT one) AS est, (SELECT chi2 FROM lx WHERE lx.spec = k.spec) AS chi2, NULL::double AS p_cr1, NULL::double AS g_eff FROM kr k GROUP BY spec),
r0 AS (SELECT *, klass = 'contraction' AS one FROM ev WHERE analysable AND (continuous OR klass IN ('contraction', 'limited'))),
r1 AS (SELECT spec, one, short AS cl, 100 * abs(disp) AS y, CASE WHEN continuous THEN -100 * doi ELSE one::int::double END AS x, CASE WHEN sized THEN CASE WHEN intensity > 0 THEN ln(intensity) END ELSE 0.0 END AS size, CASE WHEN min(symbol) OVER (PARTITION BY spec) < max(symbol) OVER (PARTITION BY spec) THEN (symbol = 'ETH')::int::double ELSE 0.0 END AS eth, 2 + sized::int + (min(symbol) OVER (PARTITION BY spec) < max(symbol) OVER (PARTITION BY spec))::int AS k FROM r0),
r2 AS (SELECT * FROM r1 WHERE y IS NOT NULL AND x IS NOT NULL AND size IS NOT NULL),
r3 AS (SELECT spec, one, cl, k, {centred(('y', 'x', 'size', 'eth'))} FROM r2),
r4 AS (SELECT spec, one, cl, k, {without('size', ('y', 'x', 'eth'))} FROM r3 WINDOW w AS (PARTITION BY spec)),
r5 AS (SELECT spec, one, cl, k, {without('eth', ('y', 'x'))} FROM r4 WINDOW w AS (PARTITION BY spec)),
r6 AS (SELECT *, sum(x * y) OVER w / sum(x * x) OVER w AS b, sum(x * x) OVER w AS sxx FROM r5 WINDOW w AS (PARTITION BY spec)),
r7 AS (SELECT spec, cl, any_value(b) AS b, any_value(k) AS k, count(*) AS n, count(*) FILTER (one) AS n1, sum(x * (y - b * x) / sxx) AS s, sum(x / sxx) AS w FROM r6 GROUP BY 1, 2),
r8 AS (SELECT spec, any_value(b) AS b, sum(n)::bigint AS n, sum(n1)::bigint AS n1, count(*) AS g, any_value(k) AS k, sum(s * s) AS ss, count(*) / (1 + var_pop(w * w) / pow(avg(w * w), 2)) AS g_eff FROM r7 GROUP BY 1),
e2 AS (SELECT spec, 'E2' AS effect, n1, n - n1 AS n2, g AS clusters, b AS est, NULL::double AS chi2, {student_sql('b / sqrt(g / (g - 1) * (n - 1) / (n - k) * ss)', 'g - 1')} AS p_cr1, g_eff FROM r8),
eff AS (SELECT e.spec, effect, n1, n2, clusters, CASE WHEN ok THEN est END AS est, CASE WHEN ok THEN chi2 END AS chi2, CASE WHEN ok THEN {chi_square_sql('chi2')} END AS p, CASE WHEN ok THEN p_cr1 END AS p_cr1, CASE WHEN ok THEN g_eff END AS g_eff FROM (SELECT u.*, (effect = 'E2' OR least(n1, n2) >= 3) AND least(a, b) >= 3 AS ok FROM (SELECT * FROM med UNION ALL SELECT * FROM e6 UNION ALL SELECT * FROM e2) u JOIN (SELECT spec, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM cx GROUP BY 1) k ON k.spec = u.spec) e)"""


def _islands(hours: int) -> str:
    return f"(SELECT spec, symbol, e0, sum(new) OVER (PARTITION BY spec ORDER BY e0, symbol)::bigint AS ep FROM (SELECT spec, symbol, e0, CASE WHEN e0 - lag(e0) OVER (PARTITION BY spec ORDER BY e0, symbol) > {(hours * 60 + 45) * M} THEN 1 ELSE 0 END AS new FROM ev0))"


def with_clusters(ev0: str, short: str = "ep6", long: str = "ep24") -> str:
    return f"WITH ev0 AS ({ev0}), ev1 AS (SELECT ev0.*, a.ep::varchar AS ep6, b.ep::varchar AS ep24, strftime(make_timestamp(e0), '%Y-%m-%d') AS \"day\", strftime(make_timestamp(e0), '%G-W%V') AS \"week\", symbol || ':' || e0 AS \"none\" FROM ev0 JOIN {_islands(6)} a USING (spec, symbol, e0) JOIN {_islands(24)} b USING (spec, symbol, e0))"


#: The exclusion's dates are counted from the first day of the tables, which all sizes share.
FIRST_DAY = 19723 * D
SPECS = grid.declared(P, (FIRST_DAY + 10 * D, FIRST_DAY + 18 * D), SHORT_WARMUP, MASKED_H)
GRID = effects_sql(with_clusters(" UNION ALL ".join(map(events_sql, SPECS))) + ", ev AS (SELECT *, ep6 AS short, ep24 AS long FROM ev1)")
ESTIMATES = "spec, effect, n1, n2, clusters, round(est, 6) AS est, round(chi2, 6) AS chi2, round(p, 6) AS p, round(p_cr1, 6) AS p_cr1, round(g_eff, 6) AS g_eff"


def estimates(found: DataFrame) -> DataFrame:
    return found.select("spec", "effect", "n1", "n2", "clusters", "est", "chi2", F.when(F.col("effect") == "E6", F.col("p")).alias("p"), "p_cr1", "g_eff")


@query("g1_effects", f"{GRID} SELECT {ESTIMATES} FROM eff")
def g1_effects(spark, d):
    return estimates(effects.effects(grid_events(spark, d)))


@query("g7_forest", f"{GRID} SELECT spec, effect, round(est, 6) AS est FROM eff WHERE effect IN ('E1', 'E2') AND NOT starts_with(spec, 'S6') AND spec <> 'S12'")
def g7_forest(spark, d):
    return effects.effects(grid_events(spark, d)).where("effect in ('E1', 'E2') and not startswith(spec, 'S6') and spec <> 'S12'").select("spec", "effect", "est")


@query("g1_counts", f"{GRID}, k AS (SELECT spec, short, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM cx GROUP BY 1, 2), k2 AS (SELECT spec, count(DISTINCT long) AS g_long FROM cx GROUP BY 1), wide AS (SELECT spec, " + ", ".join(f"max(est) FILTER (effect = 'E{i}') AS e{i}_est" for i in range(1, 7)) + f", max(p) FILTER (effect = 'E6') AS e6_p, max(p_cr1) AS e2_p_cr1, max(g_eff) AS e2_g_eff, max(clusters) FILTER (effect = 'E2') AS e2_clusters FROM eff GROUP BY 1) SELECT k.spec, sum(a)::bigint AS n_contraction, sum(b)::bigint AS n_limited, count(*) AS g_short, count(*) FILTER (a > 0 AND b > 0) AS g_short_mixed, any_value(g_long) AS g_long, (SELECT count(*) FROM ev WHERE ev.spec = k.spec AND analysable) AS n_analysable, {', '.join(f'round(any_value(e{i}_est), 6) AS e{i}_est' for i in range(1, 7))}, round(any_value(e6_p), 6) AS e6_p, round(any_value(e2_p_cr1), 6) AS e2_p_cr1, round(any_value(e2_g_eff), 6) AS e2_g_eff, any_value(e2_clusters) AS e2_clusters FROM k JOIN k2 USING (spec) LEFT JOIN wide USING (spec) GROUP BY k.spec")
def g1_counts(spark, d):
    return _flat(grid_events(spark, d), 0, 0).drop("e2_p", *[f"e{i}_{c}" for i in range(1, 7) for c in ("lo", "hi")])


def _flat(ev: DataFrame, draws: int, wild: int) -> DataFrame:
    c = staged(effects.contrast(ev))
    analysable = ev.groupBy("spec").agg(F.count_if("analysable").alias("n_analysable"))
    return effects.flat(effects.effects(ev, draws, wild), effects.cluster_counts(c, "short"), effects.cluster_counts(c, "long"), analysable)


@query("g1_intervals")
def g1_intervals(spark, d):
    return _flat(grid_events(spark, d), QUICK, QUICK_WILD)


@query("e1_intervals")
def e1_intervals(spark, d):
    return effects.verdicts(effects.effects(grid_events(spark, d, ("Primary",)), DRAWS, WILD), SIGNS)


PAIRS = " UNION ALL ".join(f"SELECT * REPLACE ('{name}' AS spec), \"{a}\" AS short, \"{b}\" AS long FROM ev1" for name, a, b in grid.CLUSTERINGS)


@query("g2_clusterings", effects_sql(with_clusters(events_sql(SPECS[0])) + f", ev AS ({PAIRS})") + f" SELECT {ESTIMATES} FROM eff")
def g2(spark, d):
    return estimates(effects.effects(grid.clusterings(grid_events(spark, d, ("Primary",)))))


@query("g2_intervals")
def g2_intervals(spark, d):
    return _flat(grid.clusterings(grid_events(spark, d, ("Primary",))), QUICK, QUICK_WILD)


# ---- the superseded definitions under the corrected inference

OLD = calm(f"SELECT * FROM (WITH {LOUT} SELECT 'legacy' AS spec, symbol, t0 + {5 * M} AS e0, CASE klass WHEN 'deleverage' THEN 'contraction' WHEN 'churn' THEN 'limited' WHEN 'middle' THEN 'intermediate' ELSE klass END AS klass, true AS analysable, peak_disloc AS disp, doi, perm_6h AS p6h, perm_24h AS p24h, CASE WHEN perm_6h IS NOT NULL AND peak_disloc <> 0 THEN least(1.0, greatest(0.0, 1 - perm_6h / peak_disloc)) END AS reversion, coalesce((hit - t0) / {M}.0, 1440.0)::double AS rec_min, hit IS NOT NULL AS rec_event, (SELECT max(r) FROM lc x WHERE x.symbol = l.symbol AND x.e BETWEEN l.t0 AND l.t1) AS intensity, true AS sized, false AS continuous, 1440.0 AS tau FROM lout l)")


def old_events(spark, d, p: Study = P) -> DataFrame:
    snaps = staged(src.dense(spark, d, calm=True))
    bars = staged(src.bars(snaps))
    return staged(superseded.outcomes(study.legacy_events(src.fills(spark, d), p), superseded.bars_with_oi(bars, snaps), p))


@query("g5_legacy_effects", effects_sql(with_clusters(OLD) + ", ev AS (SELECT *, ep6 AS short, ep24 AS long FROM ev1)") + f" SELECT {ESTIMATES} FROM eff")
def g5(spark, d):
    return estimates(effects.effects(audit.as_effect_events(old_events(spark, d), P)))

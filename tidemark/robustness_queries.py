"""Registered queries over the superseded track's robustness: headline, grids, validators, continuous measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import LOUT, D, M, P, calm, chi_square_sql, dealt_sql, query
from .effect_queries import FIRST_DAY, swap
from .functions import stats
from .operators import quality
from .plans import robustness, study, superseded
from .plans.robustness import TRIGGERS, WINDOWS, Variant
from .sources import driver_tables as src
from .storage import staged

DRAWS, SLOPE_DRAWS = 10_000, 199
WEEK = (FIRST_DAY + 10 * D, FIRST_DAY + 17 * D)


def _built(spark, d, variants: tuple[Variant, ...] = (Variant("base"),)):
    snaps = staged(src.dense(spark, d, calm=True))
    bars = staged(src.bars(snaps))
    return robustness.built(src.fills(spark, d), superseded.bars_with_oi(bars, snaps), P, variants)


def variant_sql(v: Variant) -> str:
    lout = swap(LOUT, {"quantile_cont(r, 0.99)": f"quantile_cont(r, {v.quantile})", f"<= {120 * M} THEN 0": f"<= {v.merge_min * M} THEN 0", f"t0 + {120 * M} GROUP": f"t0 + {v.trough_h * 60 * M} GROUP", f"o.t0 + {1440 * M} AND x.high": f"o.t0 + {v.censor_h * 60 * M} AND x.high"})
    return calm(f"SELECT * FROM (WITH {lout} SELECT '{v.name}' AS variant, symbol, t0, doi, klass, peak_disloc, CASE WHEN perm_6h IS NOT NULL AND peak_disloc <> 0 THEN least(1.0, greatest(0.0, 1 - perm_6h / peak_disloc)) END AS transitory_share, coalesce((hit - t0) / {M}.0, {v.censor_h * 60}.0)::double AS d, hit IS NOT NULL AS ev, (SELECT max(r) FROM lc x WHERE x.symbol = l.symbol AND x.e BETWEEN l.t0 AND l.t1) AS liq_notional FROM lout l)")


def headline_sql(cells: str, keys: str) -> str:
    """``cells``: CTEs up to ``ce`` with the keys, klass, peak_disloc, transitory_share, d and ev."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    med = lambda v: f"CASE WHEN least(count({v}) FILTER (one), count({v}) FILTER (NOT one)) >= 3 THEN quantile_cont({v}, 0.5) FILTER (one) - quantile_cont({v}, 0.5) FILTER (NOT one) END"
    return f"""{cells}, hc AS (SELECT *, klass = 'deleverage' AS one, abs(peak_disloc) AS peak FROM ce WHERE klass IN ('deleverage', 'churn')),
hm AS (SELECT {keys}, count(peak) FILTER (one) AS n_d, count(peak) FILTER (NOT one) AS n_c, {med('peak')} AS peak_diff, {med('transitory_share')} AS tr_diff FROM hc GROUP BY {keys}),
hp AS (SELECT {keys}, d, count(*) AS c, count(*) FILTER (one) AS c1, count(*) FILTER (ev) AS dd, count(*) FILTER (ev AND one) AS d1 FROM hc GROUP BY {keys}, d),
ht AS (SELECT *, sum(c) OVER w AS n, sum(c1) OVER w AS n1 FROM hp WINDOW w AS (PARTITION BY {keys} ORDER BY d DESC)),
hl AS (SELECT {keys}, sum(d1 - CASE WHEN n > 1 THEN dd * n1 / n ELSE 0 END) AS u, sum(CASE WHEN n > 1 THEN dd * (n1 / n) * (1 - n1 / n) * (n - dd) / (n - 1) ELSE 0 END) AS v FROM ht WHERE dd > 0 GROUP BY {keys})
SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, n_d, n_c, round(peak_diff, 6) AS peak_diff, round(tr_diff, 6) AS tr_diff, round(CASE WHEN v > 0 THEN u * u / v END, 6) AS lr_chi2, round({chi_square_sql("CASE WHEN v > 0 THEN u * u / v END")}, 6) AS lr_p FROM hm a LEFT JOIN hl b ON {on}"""


def _no_p(found):
    return found.drop("peak_p", "tr_p")


@query("e2_headline", headline_sql(f"WITH ce AS ({variant_sql(Variant('base'))})", "variant"))
def e2_headline(spark, d):
    return _no_p(robustness.headline(_built(spark, d), ["variant"]))


@query("e2_headline_tests")
def e2_headline_tests(spark, d):
    return robustness.headline(_built(spark, d), ["variant"], DRAWS)


G3 = "WITH ev0 AS (" + " UNION ALL ".join(map(variant_sql, TRIGGERS)) + f"), ru AS (SELECT *, 'percentile' AS rule FROM ev0 UNION ALL SELECT * REPLACE (CASE WHEN doi <= -0.025 THEN 'deleverage' WHEN doi > -0.005 THEN 'churn' ELSE 'middle' END AS klass), 'fixed' AS rule FROM ev0), ce AS (SELECT variant AS \"trigger\", * EXCLUDE (variant), 'all' AS subset FROM ru UNION ALL SELECT variant, * EXCLUDE (variant), 'ex-week' FROM ru WHERE NOT t0 BETWEEN {WEEK[0]} AND {WEEK[1]} UNION ALL SELECT variant, * EXCLUDE (variant), symbol FROM ru)"


@query("g3_grid", headline_sql(G3, '"trigger", rule, subset'))
def g3(spark, d):
    return _no_p(robustness.headline(robustness.cells(_built(spark, d, TRIGGERS), P, WEEK), ["trigger", "rule", "subset"]))


@query("g3_tests")
def g3_tests(spark, d):
    return robustness.headline(robustness.cells(_built(spark, d, TRIGGERS), P, WEEK), ["trigger", "rule", "subset"], DRAWS)


@query("g4_windows", headline_sql("WITH ce AS (" + " UNION ALL ".join(map(variant_sql, WINDOWS)) + ")", "variant"))
def g4(spark, d):
    return _no_p(robustness.headline(_built(spark, d, WINDOWS), ["variant"]))


@query("g4_tests")
def g4_tests(spark, d):
    return robustness.headline(_built(spark, d, WINDOWS), ["variant"], DRAWS)


# ---- validators and continuous measures


def _checks(spark, d, ev):
    f = src.fills(spark, d)
    return superseded.validators(ev, f.where("side = 'buy'"), src.snapshots(spark, d), src.bars(src.dense(spark, d)))


@query("e3_validators")
def e3(spark, d):
    ev = _built(spark, d)
    found = robustness.validators(ev, _checks(spark, d, ev), DRAWS)
    rank = stats.spearman_permutation(robustness.prepared(ev).select(F.concat_ws(":", "symbol", "t0").alias("id"), "oi_destroyed", "liq_notional"), "oi_destroyed", "liq_notional", SLOPE_DRAWS)
    nothing = F.lit(None).cast("bigint")
    return found.unionByName(rank.select(F.lit("spearman").alias("measure"), F.col("n").alias("n1"), nothing.alias("n2"), "est", "p"))


CHECKED = calm(f"WITH {LOUT}, pv AS (SELECT l.symbol, t0, ln(close / lag(close) OVER (PARTITION BY l.symbol, t0 ORDER BY bar)) AS r FROM lout l JOIN bars b ON b.symbol = l.symbol AND b.bar BETWEEN t0 + {120 * M} AND t0 + {720 * M}), vol AS (SELECT symbol, t0, CASE WHEN count(r) > 3 THEN stddev_samp(r) END AS post_vol FROM pv GROUP BY 1, 2), ck AS (SELECT klass = 'deleverage' AS one, ln(greatest((SELECT max(r) FROM lc x WHERE x.symbol = l.symbol AND x.e BETWEEN l.t0 AND l.t1), 1e-9)) AS log_notional, coalesce((SELECT sum(notional) > 0 FROM fills f WHERE f.symbol = l.symbol AND f.side = 'buy' AND f.t BETWEEN l.t0 AND l.t0 + {120 * M}), false)::int AS adl, 1e6 * ((SELECT avg(funding) FROM fills f WHERE f.symbol = l.symbol AND f.t BETWEEN l.t0 AND l.t0 + {120 * M}) - (SELECT avg(funding) FROM fills f WHERE f.symbol = l.symbol AND f.t BETWEEN l.t0 - {60 * M} AND l.t0)) AS funding_swing, post_vol FROM lout l LEFT JOIN vol v ON v.symbol = l.symbol AND v.t0 = l.t0 WHERE klass IN ('deleverage', 'churn'))")


@query("e3_validator_estimates", f"{CHECKED} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) FILTER (one) AS n1, count({m}) FILTER (NOT one) AS n2, round(CASE WHEN least(count({m}) FILTER (one), count({m}) FILTER (NOT one)) >= 3 THEN {f.format(m=m, c='one')} - {f.format(m=m, c='NOT one')} END, 6) AS est FROM ck" for m, f in (("log_notional", "quantile_cont({m}, 0.5) FILTER ({c})"), ("funding_swing", "quantile_cont({m}, 0.5) FILTER ({c})"), ("post_vol", "quantile_cont({m}, 0.5) FILTER ({c})"), ("adl", "avg({m}) FILTER ({c})"))))
def e3e(spark, d):
    ev = _built(spark, d)
    return robustness.validators(ev, _checks(spark, d, ev).withColumn("funding_swing", 1e6 * F.col("funding_swing"))).drop("p")


def slope_sql(y: str, controls: tuple[str, ...], draws: int = SLOPE_DRAWS) -> str:
    """Slope of y on x beside the controls, by partialling them out one after the other, in every draw."""
    names = ["y", "x", *[f"c{i}" for i in range(len(controls))]]
    steps, left = [f"z0 AS (SELECT b, {', '.join(f'{n} - avg({n}) OVER (PARTITION BY b) AS {n}' for n in names)} FROM sh)"], names
    for i in range(len(controls)):
        left = [n for n in left if n != f"c{i}"]
        steps.append(f"z{i + 1} AS (SELECT b, {', '.join(f'{n} - c{i} * coalesce(sum({n} * c{i}) OVER w / nullif(sum(c{i} * c{i}) OVER w, 0), 0) AS {n}' for n in left)} FROM z{i} WINDOW w AS (PARTITION BY b))")
    some = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"WITH ce AS ({variant_sql(Variant('base'))}), k AS (SELECT * FROM (SELECT symbol || ':' || t0 AS id, {y} AS y, -doi AS x, {', '.join(f'{c} AS c{i}' for i, c in enumerate(controls))} FROM ce) WHERE {some}), {dealt_sql('x', ' '.join(n for n in names if n != 'x'), draws)}, {', '.join(steps)}, dr AS (SELECT b, sum(x * y) / nullif(sum(x * x), 0) AS d, count(*) AS n FROM z{len(controls)} GROUP BY b) SELECT round(max(e.d), 6) AS est, round((count(*) FILTER (r.b > 0 AND abs(r.d) >= abs(e.d)) + 1) / count(*), 6) AS p, max(e.n) AS n FROM dr r, dr e WHERE e.b = 0"


SIZE, ETH = "ln(greatest(liq_notional, 1e-9))", "(symbol = 'ETH')::int::double"


def _continuous(spark, d, y: str, controls: list[str]):
    ev = robustness.prepared(_built(spark, d)).withColumn("id", F.concat_ws(":", "symbol", "t0"))
    return stats.slopes_permutation(ev, y, "oi_destroyed", controls, SLOPE_DRAWS)


@query("e4_h2a", slope_sql("abs(peak_disloc)", (SIZE, ETH)))
def e4_h2a(spark, d):
    return _continuous(spark, d, "abs_peak", ["log_notional", "asset_eth"])


@query("e4_h2b", slope_sql("transitory_share", ("abs(peak_disloc)", SIZE, ETH)))
def e4_h2b(spark, d):
    return _continuous(spark, d, "transitory_share", ["abs_peak", "log_notional", "asset_eth"])


# ---- the benchmark check: two builds of one table

FIELDS = ("klass", "doi", "peak_disloc", "ttr_min", "censored", "perm_6h", "perm_24h", "transitory_share")


@query("q7_benchmark", f"WITH t AS (WITH {calm(LOUT)} SELECT klass, peak_disloc, doi FROM lout) SELECT klass, count(*) AS n, round(quantile_cont(peak_disloc, 0.5), 6) AS med_peak, round(quantile_cont(doi, 0.5), 6) AS med_doi FROM t GROUP BY 1")
def q7(spark, d):
    """The single build is the stored table; the build of variants must give its rows and cells to 1e-12."""
    snaps = staged(src.dense(spark, d, calm=True))
    bars = staged(src.bars(snaps))
    bars_oi, fills = superseded.bars_with_oi(bars, snaps), src.fills(spark, d)
    stored = superseded.outcomes(study.legacy_events(fills, P), bars_oi, P).withColumnRenamed("doi_event", "doi")
    again = robustness.built(fills, bars_oi, P, (Variant("base"),)).select("symbol", "t0", *FIELDS)
    same = quality.verified(again, stored.select("symbol", "t0", *FIELDS), ["symbol", "t0"])
    median = lambda c, name: F.percentile(c, F.lit(0.5)).alias(name)
    return same.groupBy("klass").agg(F.count("*").alias("n"), median("peak_disloc", "med_peak"), median("doi", "med_doi"))

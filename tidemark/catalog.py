"""Registered queries over the driver tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import clock, lookups, measures, quality
from .params import DAY, MINUTE, MONTH
from .plans import audit, grid, study, superseded
from .session import ship
from .sources import context
from .sources import driver_tables as src
from .storage import staged
from .streaming import clock as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P = MONTH


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without negative zeros, counts to long: the form both engines agree on."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns])


def unsigned_zero(sql: str) -> str:
    """``sql`` with 0.0 added to each ``round(...)``, so that no negative zero is left."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}({sql[at:end]} + 0.0){sql[end:]}"
        at += 7
    return sql


def chi_square_sql(x: str) -> str:
    """Tail of chi-square with one degree of freedom, by the series of the incomplete gamma function."""
    terms = "list_sum([exp(-x_ / 2 + (k + 0.5) * ln(x_ / 2) - lgamma(k + 1.5)) for k in range(400)])"
    return f"(SELECT CASE WHEN x_ = 0 THEN 1.0 WHEN x_ > 300 THEN 0.0 ELSE 1 - {terms} END FROM (SELECT {x} AS x_))"


def student_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t with whole degrees of freedom, with the coefficients as ratios of gamma functions."""
    even = "sin(a) * coalesce(list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(a), 2 * k) for k in range(f // 2)]), 0)"
    odd = "2 / pi() * (a + sin(a) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(a), 2 * k + 1) for k in range(f // 2)]), 0))"
    return f"(SELECT CASE WHEN f < 1 THEN NULL WHEN f % 2 = 1 THEN 1 - {odd} ELSE 1 - {even} END FROM (SELECT f, atan(abs(t) / sqrt(f)) AS a FROM (SELECT {t} AS t, {df} AS f)))"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @functools.wraps(f)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(ship(spark), sf_dir))

        QUERIES[name] = call
        if sql is not None:
            whole = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
            ORACLE[name] = unsigned_zero(whole)
        return f

    return add


W, D = 5 * MINUTE, DAY
FILLS = """fills AS (SELECT event_id AS ingest_idx, epoch_us(ts) AS t, CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS symbol,
 CASE WHEN event_type IN ('view', 'click', 'error') THEN 'sell' ELSE 'buy' END AS side,
 CASE event_type WHEN 'view' THEN 'Close Long' WHEN 'click' THEN 'Liquidated Cross Long' WHEN 'error' THEN 'Liquidated Isolated Long' WHEN 'purchase' THEN 'Close Short' ELSE 'Liquidated Cross Short' END AS direction,
 100.0::double AS px, value / 100 AS sz, value AS notional, 100 + value / 50 AS spx, 1000 + 10 * value AS oi, (value - 50) / 1e6 AS funding FROM events)"""
COV = f"{FILLS}, cov AS (SELECT symbol, min(t) // {D} * {D} AS c0, max(t) // {D} * {D} + {D} AS c1 FROM fills GROUP BY symbol)"


def bins_sql(label: str = "right", side: str = "side = 'sell'") -> str:
    s = W if label == "right" else 0
    return f"{COV}, grid AS (SELECT symbol, unnest(range(c0 + {s}, c1 + {s}, {W})) AS e FROM cov), bins AS (SELECT g.symbol, g.e, coalesce(v, 0.0) AS notional, coalesce(n, 0) AS n FROM grid g LEFT JOIN (SELECT symbol, t // {W} * {W} + {s} AS e, sum(notional) AS v, count(*) AS n FROM fills WHERE {side} GROUP BY 1, 2) x ON x.symbol = g.symbol AND x.e = g.e)"


def trig_sql(q: float = 0.99, quiet: int = 120) -> str:
    return f"""{bins_sql()}, roll AS (SELECT *, CASE WHEN count(notional) OVER w = 3 THEN sum(notional) OVER w END AS r FROM bins WINDOW w AS (PARTITION BY symbol ORDER BY e ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
thr AS (SELECT *, quantile_cont(r, {q}) OVER (PARTITION BY symbol ORDER BY e RANGE BETWEEN {7 * D} PRECEDING AND 1 PRECEDING) AS thr, min(e) OVER (PARTITION BY symbol) + {2 * W + 7 * D} AS from_e FROM roll),
trig AS (SELECT symbol, e, notional, r, thr, e >= from_e AS eligible, coalesce(e >= from_e AND r > 0 AND r >= thr, false) AS trigger FROM thr),
ch0 AS (SELECT *, CASE WHEN e - lag(e) OVER w > {quiet * MINUTE} OR lag(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM trig WHERE trigger WINDOW w AS (PARTITION BY symbol ORDER BY e)),
ch AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY e) - 1 AS chain FROM ch0),
ons AS (SELECT symbol, chain, min(e) AS e0, max(e) AS chain_end, count(*) AS n_triggers_chain, arg_min(r, e) AS r_onset, arg_min(thr, e) AS thr_onset FROM ch GROUP BY 1, 2)"""


TRIG = trig_sql()
DENSE = f"{COV}, mins AS (SELECT symbol, unnest(range(c0, c1, {MINUTE})) AS t FROM cov), dense AS (SELECT m.symbol, m.t, f.spx AS px, f.oi, f.funding FROM mins m ASOF JOIN (SELECT symbol, t, arg_max(spx, ingest_idx) AS spx, arg_max(oi, ingest_idx) AS oi, arg_max(funding, ingest_idx) AS funding FROM fills GROUP BY 1, 2) f ON m.symbol = f.symbol AND m.t >= f.t)"
BARS = f"bars AS (SELECT symbol, t // {W} * {W} AS bar, arg_min(px, t) AS open, max(px) AS high, min(px) AS low, arg_max(px, t) AS close, t // {W} * {W} + {W} AS bar_end FROM dense GROUP BY symbol, t // {W})"


def both_sql(q: float = 0.99) -> str:
    return trig_sql(q) + ", " + DENSE[len(COV) + 2 :] + ", " + BARS


M = MINUTE
MEAS = f"""{both_sql()},
ref AS (SELECT o.symbol, o.e0, count(b.close) AS ref_bars, CASE WHEN count(b.close) >= 4 THEN CASE WHEN min(b.close) = max(b.close) THEN min(b.close) ELSE avg(b.close) END END AS p_ref FROM ons o LEFT JOIN bars b ON b.symbol = o.symbol AND b.bar BETWEEN o.e0 - {45 * M} AND o.e0 - {20 * M} GROUP BY 1, 2),
ends AS (SELECT symbol, max(bar_end) AS data_end FROM bars GROUP BY symbol),
win AS (SELECT o.symbol, o.e0, count(b.low) AS w_bars, min(b.low) AS low, arg_min(b.bar, (b.low, b.bar)) AS trough FROM ons o LEFT JOIN bars b ON b.symbol = o.symbol AND b.bar BETWEEN o.e0 - {15 * M} AND o.e0 + {115 * M} GROUP BY 1, 2),
m2 AS (SELECT r.symbol, r.e0, ref_bars, p_ref, w_bars, data_end, w_bars >= 25 AND r.e0 + {120 * M} <= data_end AS w_ok, CASE WHEN w_bars >= 25 AND r.e0 + {120 * M} <= data_end AND p_ref IS NOT NULL THEN trough END AS trough, CASE WHEN w_bars >= 25 AND r.e0 + {120 * M} <= data_end AND p_ref IS NOT NULL THEN ln(low / p_ref) END AS disp FROM ref r JOIN win w ON w.symbol = r.symbol AND w.e0 = r.e0 JOIN ends x ON x.symbol = r.symbol),
og AS (SELECT symbol, e0, 'base' AS part, unnest(range(e0 - {75 * M}, e0 - {15 * M} + 1, {W})) AS g FROM ons UNION ALL SELECT symbol, e0, 'trough', unnest(range(e0 - {10 * M}, e0 + {120 * M} + 1, {W})) FROM ons),
oa AS (SELECT og.*, CASE WHEN og.g - d.t <= {2 * M} THEN d.oi END AS oi FROM og ASOF LEFT JOIN dense d ON d.symbol = og.symbol AND og.g >= d.t),
m3a AS (SELECT symbol, e0, count(oi) FILTER (part = 'base') AS oi_base_n, count(oi) FILTER (part = 'trough') AS oi_trough_n, avg(oi) FILTER (part = 'base') AS b, min(oi) FILTER (part = 'trough') AS l FROM oa GROUP BY 1, 2),
m3 AS (SELECT symbol, e0, oi_base_n, oi_trough_n, CASE WHEN oi_base_n >= 11 AND oi_trough_n >= 24 THEN (l - b) / b END AS doi FROM m3a),
pg AS (SELECT symbol, e0, p_ref, data_end, h, e0 + h * {60 * M} AS g FROM m2, (VALUES (6), (24)) v(h)),
pa AS (SELECT pg.*, CASE WHEN pg.g - b.bar_end <= {10 * M} AND pg.g <= data_end THEN ln(b.close / p_ref) END AS v FROM pg ASOF LEFT JOIN bars b ON b.symbol = pg.symbol AND pg.g >= b.bar_end),
m4 AS (SELECT symbol, e0, max(v) FILTER (h = 6) AS p6h, max(v) FILTER (h = 24) AS p24h FROM pa GROUP BY 1, 2),
fs AS (SELECT m.symbol, m.e0, m.p_ref, m.e0 + {120 * M} AS s, b.bar_end, b.close, b.bar_end - coalesce(lag(b.bar_end) OVER (PARTITION BY m.symbol, m.e0 ORDER BY b.bar_end), m.e0 + {120 * M}) AS gap FROM m2 m JOIN bars b ON b.symbol = m.symbol AND b.bar_end > m.e0 + {120 * M} AND b.bar_end <= m.e0 + {1440 * M}),
fk AS (SELECT *, sum(CASE WHEN gap > {15 * M} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, e0 ORDER BY bar_end) AS broken FROM fs),
fa AS (SELECT symbol, e0, min(bar_end) FILTER (close >= p_ref * 0.999) AS hit, max(bar_end) AS fu FROM fk WHERE broken = 0 GROUP BY 1, 2),
m6 AS (SELECT m.symbol, m.e0, CASE WHEN p_ref IS NOT NULL THEN greatest(0.0, (coalesce(hit, fu, m.e0 + {120 * M}) - m.e0 - {120 * M}) / {M}.0) END AS rec_min, CASE WHEN p_ref IS NOT NULL THEN hit IS NOT NULL END AS rec_event, CASE WHEN p_ref IS NOT NULL THEN hit IS NOT NULL OR coalesce(fu, 0) >= m.e0 + {1440 * M} END AS rec_complete FROM m2 m LEFT JOIN fa ON fa.symbol = m.symbol AND fa.e0 = m.e0),
cl0 AS (SELECT m2.*, oi_base_n, oi_trough_n, doi, p6h, p24h, rec_min, rec_event, rec_complete, count(doi) OVER w AS n_prior, quantile_cont(doi, 0.1) OVER w AS q FROM m2 JOIN m3 USING (symbol, e0) JOIN m4 USING (symbol, e0) JOIN m6 USING (symbol, e0) WINDOW w AS (PARTITION BY symbol ORDER BY e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl1 AS (SELECT *, CASE WHEN doi IS NOT NULL THEN CASE WHEN n_prior >= 20 THEN q ELSE -0.025 END END AS contraction_cut FROM cl0),
cls AS (SELECT c.*, r_onset, concat_ws(';', CASE WHEN p_ref IS NULL THEN 'reference_bars' END, CASE WHEN NOT w_ok THEN 'window_bars_or_beyond_data' END, CASE WHEN oi_base_n < 11 THEN 'oi_baseline' END, CASE WHEN oi_trough_n < 24 THEN 'oi_trough' END) AS reason, CASE WHEN doi IS NULL THEN 'unknown' WHEN doi <= contraction_cut THEN 'contraction' WHEN doi > -0.005 THEN 'limited' ELSE 'intermediate' END AS klass, CASE WHEN p6h IS NOT NULL AND disp <> 0 THEN least(1.0, greatest(0.0, 1 - p6h / disp)) END AS reversion FROM cl1 c JOIN ons o ON o.symbol = c.symbol AND o.e0 = c.e0),
fin AS (SELECT *, reason = '' AND klass <> 'unknown' AS analysable FROM cls)"""


def calm(sql: str) -> str:
    """``sql`` with the alternating open interest of ``driver_tables.snapshots(calm=True)``, which yields both classes."""
    return sql.replace("1000 + 10 * value AS oi", f"1000 + CASE WHEN epoch_us(ts) // {D // 2} % 2 = 0 THEN 10.0 ELSE 0.02 END * value AS oi")


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ---- sources and quality


@query("s4_snapshot_dedup", f"{FILLS} SELECT symbol, t, round(arg_min(spx, ingest_idx), 6) AS px, round(arg_min(oi, ingest_idx), 6) AS oi FROM fills GROUP BY 1, 2")
def s4(spark, d):
    return src.first_of(src.snapshots(spark, d), ["symbol", "t"]).select("symbol", "t", "px", "oi")


@query("s5_funding", f"{FILLS} SELECT symbol, t, round(funding * 1e6, 6) AS funding_ppm FROM fills WHERE funding IS NOT NULL")
def s5(spark, d):
    return src.snapshots(spark, d).na.drop(subset=["funding"]).select("symbol", "t", (F.col("funding") * 1e6).alias("funding_ppm"))


@query("s7_full_row_dedup", f"{FILLS} SELECT symbol, count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, t, side, direction, px, sz FROM fills) x WHERE x.symbol = f.symbol) AS removed FROM fills f GROUP BY symbol")
def s7(spark, d):
    f = src.fills(spark, d).select("symbol", "t", "side", "direction", "px", "sz")
    return f.groupBy("symbol").count().join(f.dropDuplicates().groupBy("symbol").agg(F.count("*").alias("k")), "symbol").select("symbol", (F.col("count") - F.col("k")).alias("removed"))


@query("s11_missing_days", f"SELECT o_orderpriority AS symbol, d FROM (SELECT o_orderpriority, unnest(range(min(k), max(k) + 1)) AS d FROM (SELECT o_orderpriority, epoch_us(o_orderdate) // {D} AS k FROM orders) GROUP BY 1) x WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = x.o_orderpriority AND epoch_us(o.o_orderdate) // {D} = x.d)")
def s11(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), src.micros("o_orderdate").alias("t"))
    return quality.missing_days(o)


@query("s12_coverage", f"{FILLS} SELECT symbol, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t FROM fills GROUP BY symbol")
def s12(spark, d):
    return src.fills(spark, d).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("s13_rows_per_day", f"{FILLS} SELECT t // {D} AS d, count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT direction) AS directions FROM fills GROUP BY 1")
def s13(spark, d):
    return src.fills(spark, d).groupBy(F.floor(F.col("t") / D).alias("d")).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("direction").alias("directions"))


@query("f1_sells", f"{FILLS} SELECT ingest_idx, symbol, round(notional, 6) AS notional FROM fills WHERE side = 'sell'")
def f1(spark, d):
    return src.fills(spark, d).where("side = 'sell'").select("ingest_idx", "symbol", "notional")


@query("f2_permissive_sells", f"{FILLS} SELECT symbol, count(*) AS n FROM fills WHERE lower(side) IN ('sell', 'a', 'ask') GROUP BY symbol")
def f2(spark, d):
    return quality.permissive_sells(src.fills(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"))


@query("f3_side_check", f"{FILLS} SELECT symbol, count(*) FILTER (side NOT IN ('sell', 'buy')) AS bad_side, count(*) FILTER (side = 'sell' AND direction NOT IN ('Close Long', 'Liquidated Cross Long', 'Liquidated Isolated Long')) AS bad_sell, count(*) FILTER (side = 'buy' AND NOT contains(direction, 'Short')) AS bad_buy, count(*) FILTER (side = 'sell') AS sell_rows, count(*) FILTER (side = 'buy') AS buy_rows FROM fills GROUP BY symbol")
def f3(spark, d):
    return quality.side_check(src.fills(spark, d))


@query("f4_coverage_bounds", f"{COV} SELECT * FROM cov")
def f4(spark, d):
    return src.coverage(src.fills(spark, d))


@query("o7_dropped_rows", f"{FILLS}, k AS (SELECT * FROM fills WHERE direction <> 'Close Short'), g AS (SELECT symbol, ingest_idx, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n_dropped FROM k) SELECT * FROM g WHERE n_dropped > 0")
def o7(spark, d):
    # a stored table in which the rows of one direction were lost
    return quality.dropped(src.fills(spark, d).where("direction <> 'Close Short'")).select("symbol", "ingest_idx", "n_dropped")


@query("o6_reinstated", f"{FILLS}, k AS (SELECT * FROM fills WHERE direction <> 'Close Short'), g AS (SELECT *, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n FROM k) SELECT symbol, side, count(*) + coalesce(sum(n) FILTER (n > 0), 0)::bigint AS n_rows, round(sum(notional) + coalesce(sum(n * notional) FILTER (n > 0), 0), 4) AS notional FROM g GROUP BY 1, 2")
def o6(spark, d):
    f = src.fills(spark, d).where("direction <> 'Close Short'")
    return quality.reinstated(f, quality.dropped(f)).groupBy("symbol", "side").agg(F.count("*").alias("n_rows"), F.round(F.sum("notional"), 4).alias("notional"))


@query("q2_grid_gaps", f"{FILLS}, g AS (SELECT symbol, t, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM fills) SELECT symbol, max(t // {M}) - min(t // {M}) + 1 AS grid_points, max(t // {M}) - min(t // {M}) + 1 - count(DISTINCT t // {M}) AS missing, count(*) FILTER (t % {M} <> 0) AS off_grid, round(max(gap) / {M}.0, 6) AS max_gap_min FROM g GROUP BY symbol")
def q2(spark, d):
    return quality.grid_gaps(src.fills(spark, d))


@query("a6_duplicate_profile", f"{FILLS}, p AS (SELECT symbol, t, count(*) AS n FROM fills GROUP BY 1, 2), x AS (SELECT symbol, count(*) AS n FROM fills GROUP BY symbol, t, side, px, sz) SELECT symbol, sum(n)::bigint AS n_rows, count(*) AS distinct_times, coalesce(sum(n) FILTER (n > 1), 0)::bigint AS shared_rows, (SELECT sum(n) - count(*) FROM x WHERE x.symbol = p.symbol)::bigint AS exact_repeats FROM p GROUP BY symbol")
def a6(spark, d):
    return quality.duplicates(src.fills(spark, d))


@query("q3_side_ambiguity", f"{FILLS}, k AS (SELECT * REPLACE (t // {W} * {W} AS t) FROM fills WHERE direction <> 'Close Short'), g AS (SELECT *, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n FROM k), b AS (SELECT symbol, t, min(side) <> max(side) AS two FROM k GROUP BY 1, 2) SELECT g.symbol, sum(n)::bigint AS n_dropped, round(sum(n * two::int) / sum(n), 6) AS ambiguous_share FROM g JOIN b ON b.symbol = g.symbol AND b.t = g.t WHERE n > 0 GROUP BY 1")
def q3(spark, d):
    f = src.fills(spark, d).where("direction <> 'Close Short'").withColumn("t", (F.floor(F.col("t") / W) * W).cast("bigint"))
    return quality.side_ambiguity(f, quality.dropped(f))


@query("q4_empty_bins", f"{bins_sql('right', 'true')} SELECT symbol, round(avg((n = 0)::int), 6) AS empty_share FROM bins GROUP BY symbol")
def q4(spark, d):
    return clock.bins(src.fills(spark, d), P, None).groupBy("symbol").agg(F.avg((F.col("n") == 0).cast("int")).alias("empty_share"))


ZERO = f"{bins_sql('right', 'true')}, z AS (SELECT symbol, e, e - row_number() OVER (PARTITION BY symbol ORDER BY e) * {W} AS g FROM bins WHERE n = 0), runs AS (SELECT symbol, min(e) - {W} AS run_start, max(e) AS run_end, count(*) * 5 / 60.0 AS hours FROM z GROUP BY symbol, g)"


@query("b8_zero_runs", f"{ZERO} SELECT symbol, run_start, run_end, round(hours, 6)::double AS hours FROM runs WHERE hours >= 0.25")
def b8(spark, d):
    return clock.zero_runs(src.fills(spark, d), P, 0.25)


@query("q5_zero_run_counts", f"{ZERO} SELECT symbol, count(*) FILTER (hours >= 0.5) AS n_half, count(*) FILTER (hours >= 1) AS n_one, round(coalesce(max(hours) FILTER (hours >= 0.5), 0), 6)::double AS longest FROM runs GROUP BY symbol")
def q5(spark, d):
    r = clock.zero_runs(src.fills(spark, d), P, 0)
    return r.groupBy("symbol").agg(F.count_if(F.col("hours") >= 0.5).alias("n_half"), F.count_if(F.col("hours") >= 1).alias("n_one"), F.coalesce(F.max(F.when(F.col("hours") >= 0.5, F.col("hours"))), F.lit(0.0)).alias("longest"))


@query("b9_masked_bins", f"{ZERO}, s AS (SELECT * FROM runs WHERE hours >= 0.5) SELECT b.symbol, count(*) AS n_masked FROM bins b JOIN s ON s.symbol = b.symbol AND b.e > s.run_start AND b.e <= s.run_end GROUP BY 1")
def b9(spark, d):
    f = src.fills(spark, d)
    return clock.mask_runs(clock.bins(f, P), clock.zero_runs(f, P, 0.5)).where("notional is null").groupBy("symbol").agg(F.count("*").alias("n_masked"))


@query("a4_side_direction", f"{FILLS} SELECT direction, count(*) FILTER (side = 'buy') AS buy, count(*) FILTER (side = 'sell') AS sell FROM fills GROUP BY 1")
def a4(spark, d):
    return src.fills(spark, d).groupBy("direction").pivot("side", ["buy", "sell"]).count().na.fill(0)


@query("a8_notional_by_side", f"{FILLS} SELECT symbol, round(sum(notional) FILTER (side = 'sell'), 4) AS sell, round(sum(notional) FILTER (side = 'buy'), 4) AS buy FROM fills GROUP BY symbol")
def a8(spark, d):
    return src.fills(spark, d).groupBy("symbol").agg(*[F.round(F.sum(F.when(F.col("side") == s, F.col("notional"))), 4).alias(s) for s in ("sell", "buy")])


@query("a9_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def a9(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.expr("substr(cast(o_orderdate as string), 1, 7)").alias("month")).agg(F.count("*").alias("n"))


# ---- the clock


@query("b1_right_bins", f"{bins_sql()} SELECT symbol, e, round(notional, 6) AS notional, n FROM bins")
def b1(spark, d):
    return clock.bins(src.fills(spark, d), P)


@query("b1_left_bins", f"{bins_sql('left')} SELECT symbol, e, round(notional, 6) AS notional, n FROM bins")
def b1_left(spark, d):
    return clock.bins(src.fills(spark, d), P.but(label="left"))


@query("b2_rolling", f"{TRIG} SELECT symbol, e, round(r, 6) AS r FROM roll")
def b2(spark, d):
    return clock.rolled(clock.bins(src.fills(spark, d), P), P).select("symbol", "e", "r")


@query("b3_rolling_partial", f"{bins_sql('left')} SELECT symbol, e, round(sum(notional) OVER (PARTITION BY symbol ORDER BY e RANGE BETWEEN {15 * M - 1} PRECEDING AND CURRENT ROW), 6) AS r FROM bins")
def b3(spark, d):
    return clock.rolled_partial(clock.bins(src.fills(spark, d), P.but(label="left"))).select("symbol", "e", "r")


@query("b4_prior_quantile", f"{TRIG} SELECT symbol, e, {r6('r', 'thr')} FROM thr")
def b4(spark, d):
    return clock.thresholds(clock.rolled(clock.bins(src.fills(spark, d), P), P), P).select("symbol", "e", "r", "thr")


LEGACY = f"{bins_sql('left')}, lr AS (SELECT symbol, e, sum(notional) OVER (PARTITION BY symbol ORDER BY e RANGE BETWEEN {15 * M - 1} PRECEDING AND CURRENT ROW) AS r FROM bins), lt AS (SELECT *, CASE WHEN count(r) OVER w >= 2016 THEN quantile_cont(r, 0.99) OVER w END AS thr FROM lr WINDOW w AS (PARTITION BY symbol ORDER BY e RANGE BETWEEN {7 * D - 1} PRECEDING AND CURRENT ROW)), lg AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY symbol ORDER BY e) <= {120 * M} THEN 0 ELSE 1 END AS new FROM lt WHERE r >= thr AND r > 0), lc AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY e) AS chain FROM lg)"


@query("b5_legacy_threshold", f"{LEGACY} SELECT symbol, e, {r6('r', 'thr')} FROM lt")
def b5(spark, d):
    return study.legacy_threshold(src.fills(spark, d), P).select("symbol", "e", "r", "thr")


@query("c4_legacy_events", f"{LEGACY}, lo AS (SELECT symbol, min(e) AS t0, max(e) AS t1 FROM lc GROUP BY symbol, chain) SELECT lo.symbol, t0, t1, round(max(r), 6) AS liq_notional FROM lo JOIN lr ON lr.symbol = lo.symbol AND lr.e BETWEEN t0 AND t1 GROUP BY 1, 2, 3")
def c4(spark, d):
    return study.legacy_events(src.fills(spark, d), P)


@query("b7_trigger_table", f"{TRIG} SELECT symbol, e, {r6('notional', 'r', 'thr')}, eligible, trigger FROM trig WHERE eligible")
def b7(spark, d):
    return clock.triggers(src.fills(spark, d), P).where("eligible")


@query("b11_bars", f"{DENSE}, {BARS} SELECT symbol, bar, {r6('open', 'high', 'low', 'close')} FROM bars")
def b11(spark, d):
    return src.bars(src.dense(spark, d)).select("symbol", "bar", "open", "high", "low", "close")


@query("b12_lagged_changes", f"{DENSE}, {BARS}, l AS (SELECT symbol, bar, close, lag(close, 12) OVER (PARTITION BY symbol ORDER BY bar) AS b FROM bars) SELECT symbol, bar, round(close / b - 1, 6) AS pct, round(ln(close / b), 6) AS logret FROM l")
def b12(spark, d):
    return study.lagged_changes(src.bars(src.dense(spark, d)), 12)


@query("b14_daily_close", f"{DENSE}, {BARS} SELECT symbol, bar // {D} AS d, round(arg_max(close, bar), 6) AS close FROM bars GROUP BY 1, 2")
def b14(spark, d):
    return src.bars(src.dense(spark, d)).groupBy("symbol", F.floor(F.col("bar") / D).alias("d")).agg(F.max_by("close", "bar").alias("close"))


ONSETS = f"""SELECT o.symbol, e0, chain_end, n_triggers_chain, (SELECT count(*) FROM ch WHERE ch.symbol = o.symbol AND ch.chain = o.chain AND ch.e <= o.e0 + {120 * M}) AS n_triggers_in_window, {r6('r_onset', 'thr_onset')}, round((chain_end - e0) / {M}.0, 6) AS chain_span_min, (chain_end - e0) > {120 * M} AS cascade_continues,
 round((SELECT sum(notional) FROM trig t WHERE t.symbol = o.symbol AND t.e > o.e0 - {15 * M} AND t.e <= o.e0 + {120 * M}), 6) AS notional_w, round((SELECT max(r) FROM trig t WHERE t.symbol = o.symbol AND t.e BETWEEN o.e0 AND o.chain_end), 6) AS r_max_chain FROM ons o"""


@query("c1_onsets", f"{TRIG} {ONSETS}")
def c1(spark, d):
    return clock.onsets(clock.triggers(src.fills(spark, d), P), P)


ISL = "SELECT symbol, e0, sum(new) OVER (ORDER BY e0, symbol) - 1 AS {n} FROM (SELECT symbol, e0, CASE WHEN e0 - lag(e0) OVER (ORDER BY e0, symbol) > {g} THEN 1 WHEN lag(e0) OVER (ORDER BY e0, symbol) IS NULL THEN 1 ELSE 0 END AS new FROM ons)"


@query("c7_episodes", f"{TRIG} SELECT symbol, e0, episode::bigint AS episode FROM ({ISL.format(n='episode', g=405 * M)})")
def c7(spark, d):
    return clock.islands(clock.onsets(clock.triggers(src.fills(spark, d), P), P).select("symbol", "e0"), 405)


@query("c8_calendar_clusters", f"{TRIG} SELECT symbol, e0, strftime(make_timestamp(e0), '%Y-%m-%d') AS day, strftime(make_timestamp(e0), '%G-W%V') AS week FROM ons")
def c8(spark, d):
    return study.calendar(clock.onsets(clock.triggers(src.fills(spark, d), P), P).select("symbol", "e0"))


# ---- lookups


@query("j1_asof_max_age", f"{bins_sql()} SELECT b.symbol, b.e, round(CASE WHEN b.e - f.t <= {2 * M} THEN f.spx END, 6) AS px FROM bins b ASOF LEFT JOIN (SELECT symbol, t, arg_max(spx, ingest_idx) AS spx FROM fills GROUP BY 1, 2) f ON f.symbol = b.symbol AND b.e >= f.t")
def j1(spark, d):
    probes = clock.bins(src.fills(spark, d), P).select("symbol", "e")
    return lookups.asof(probes, src.snapshots(spark, d), ["px"], 2, at="e").select("symbol", "e", "px")


@query("j2_limited_fill", f"{bins_sql()}, v AS (SELECT symbol, e, CASE WHEN n > 0 THEN notional END AS x FROM bins), w AS (SELECT *, count(x) OVER (PARTITION BY symbol ORDER BY e) AS run FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY e) AS i, first_value(x) OVER (PARTITION BY symbol, run ORDER BY e) AS f FROM w) SELECT symbol, e, round(CASE WHEN run > 0 AND i <= 4 THEN f END, 6) AS x FROM k")
def j2(spark, d):
    v = clock.bins(src.fills(spark, d), P).select("symbol", "e", F.when(F.col("n") > 0, F.col("notional")).alias("x"))
    return lookups.fill_limited(v, "x", 3, time="e")


@query("j4_sell_buy_matches", f"{FILLS} SELECT count(*) AS n FROM fills a JOIN fills b ON a.symbol = b.symbol AND a.t // {60 * M} = b.t // {60 * M} AND a.px = b.px AND round(a.sz, 2) = round(b.sz, 2) WHERE a.side = 'sell' AND b.side = 'buy'")
def j4(spark, d):
    f = src.fills(spark, d).select("symbol", F.floor(F.col("t") / (60 * M)).alias("h"), "px", quality.scaled("sz", 2).alias("z"), "side")
    return quality.equal_pairs(f, ["symbol", "h", "px", "z"])


@query("j4_exact_matches", f"{FILLS} SELECT count(*) AS n FROM fills a JOIN fills b ON a.symbol = b.symbol AND a.t = b.t AND a.px = b.px AND a.sz = b.sz WHERE a.side = 'sell' AND b.side = 'buy'")
def j4x(spark, d):
    return quality.equal_pairs(src.fills(spark, d), ["symbol", "t", "px", "sz"])


@query("j5_window_join", f"{TRIG} SELECT o.symbol, o.e0, count(*) AS n, round(sum(f.notional), 6) AS v FROM ons o JOIN fills f ON f.symbol = o.symbol AND f.t BETWEEN o.e0 - {60 * M} AND o.e0 + {60 * M} GROUP BY 1, 2")
def j5(spark, d):
    f = src.fills(spark, d)
    o = clock.onsets(clock.triggers(f, P), P).select("symbol", "e0")
    return lookups.in_range(o, f.select("symbol", "t", "notional"), F.col("e0") - 60 * M, F.col("e0") + 60 * M).groupBy("symbol", "e0").agg(F.count("*").alias("n"), F.sum("notional").alias("v"))


@query("j6_overlaps", f"{TRIG}, {ZERO[len(COV) + 2:].replace('grid AS', 'grid2 AS').replace('FROM grid g', 'FROM grid2 g').replace('bins AS', 'bins2 AS').replace('FROM bins', 'FROM bins2')} SELECT symbol, e0, EXISTS (SELECT 1 FROM runs r WHERE r.symbol = o.symbol AND r.hours >= 0.5 AND r.run_start < o.e0 + {120 * M} AND r.run_end > o.e0 - {15 * M}) AS overlaps FROM ons o")
def j6(spark, d):
    f = src.fills(spark, d)
    return study.overlapping(clock.onsets(clock.triggers(f, P), P).select("symbol", "e0"), clock.zero_runs(f, P, 0.5), P)


@query("j11_first_at_or_after", f"{both_sql()} SELECT o.symbol, o.e0, round((SELECT arg_min(close, bar) FROM bars b WHERE b.symbol = o.symbol AND b.bar >= o.e0 + {360 * M}), 6) AS close FROM ons o")
def j11(spark, d):
    o = clock.onsets(clock.triggers(src.fills(spark, d), P), P).select("symbol", "e0").withColumn("at", F.col("e0") + 360 * M)
    b = src.bars(src.dense(spark, d)).select("symbol", F.col("bar").alias("t"), "close")
    return lookups.forward(o, b, "close", "at").select("symbol", "e0", "close")


# ---- measures and study

study_columns = "ref_bars w_bars oi_base_n oi_trough_n".split()


def _study(spark, d, calm: bool = False) -> DataFrame:
    return study.build(spark, d, P, calm)


def study_query(name: str, columns: list[str], doubles: list[str]) -> None:
    plain = [c for c in columns if c not in doubles]
    sql = f"{MEAS} SELECT symbol, e0, {', '.join(plain + [f'round({c}, 6) AS {c}' for c in doubles])} FROM fin"
    query(name, sql)(lambda spark, d: _study(spark, d).select("symbol", "e0", *columns))


study_query("m1_reference", ["ref_bars", "p_ref"], ["p_ref"])
study_query("m2_displacement", ["w_bars", "trough", "disp"], ["disp"])
study_query("m3_oi_response", ["oi_base_n", "oi_trough_n", "doi"], ["doi"])
study_query("m4_persistence", ["p6h", "p24h"], ["p6h", "p24h"])
study_query("m6_first_passage", ["rec_min", "rec_event", "rec_complete"], ["rec_min"])
study_query("m8_reversion", ["reversion"], ["reversion"])
study_query("m9_classify", ["contraction_cut", "klass"], ["contraction_cut"])
study_query("f9_reasons", ["reason", "analysable"], [])


OTHER = f"""ps AS (SELECT m.symbol, m.e0, m.trough + {W} AS s, b.bar_end, b.close >= m.p_ref * 0.999 AS c_met, b.high >= m.p_ref * 0.999 AS h_met, b.bar_end - coalesce(lag(b.bar_end) OVER (PARTITION BY m.symbol, m.e0 ORDER BY b.bar_end), m.trough + {W}) AS gap FROM m2 m JOIN bars b ON b.symbol = m.symbol AND b.bar_end > m.trough + {W} AND b.bar_end <= m.e0 + {1440 * M}),
pk AS (SELECT *, sum(CASE WHEN gap > {15 * M} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, e0 ORDER BY bar_end) AS broken FROM ps),
pf AS (SELECT symbol, e0, min(bar_end) FILTER (c_met) AS c_hit, min(bar_end) FILTER (h_met) AS h_hit, max(bar_end) AS fu FROM pk WHERE broken = 0 GROUP BY 1, 2),
m7 AS (SELECT m.symbol, m.e0, """ + ", ".join(f"CASE WHEN p_ref IS NOT NULL AND trough IS NOT NULL THEN {v} END AS rec_trough_{k}_{n}" for k in ("close", "high") for n, v in (("min", f"greatest(0.0, (coalesce({k[0]}_hit, fu, trough + {W}) - m.e0) / {M}.0)"), ("event", f"{k[0]}_hit IS NOT NULL"), ("complete", f"{k[0]}_hit IS NOT NULL OR coalesce(fu, trough + {W}) >= m.e0 + {1440 * M}"))) + " FROM m2 m LEFT JOIN pf ON pf.symbol = m.symbol AND pf.e0 = m.e0)"


@query("m7_other_passages", f"{MEAS}, {OTHER} SELECT symbol, e0, rec_trough_close_event, rec_trough_close_complete, rec_trough_high_event, rec_trough_high_complete, {r6('rec_trough_close_min', 'rec_trough_high_min')} FROM m7")
def m7(spark, d):
    return _study(spark, d).select("symbol", "e0", *[f"rec_trough_{k}_{x}" for k in ("close", "high") for x in ("min", "event", "complete")])


ALL = """symbol e0 chain_end n_triggers_chain n_triggers_in_window r_onset thr_onset chain_span_min cascade_continues notional_w r_max_chain ref_bars p_ref w_bars data_end w_ok trough disp oi_base_n oi_trough_n doi p6h p24h
rec_min rec_event rec_complete rec_trough_close_min rec_trough_close_event rec_trough_close_complete rec_trough_high_min rec_trough_high_event rec_trough_high_complete reason contraction_cut klass reversion analysable""".split()
EXACT = set("symbol e0 chain_end n_triggers_chain n_triggers_in_window cascade_continues ref_bars w_bars data_end w_ok trough oi_base_n oi_trough_n reason klass analysable".split())


@query("m12_study", f"{MEAS}, {OTHER}, on12 AS ({ONSETS}), all12 AS (SELECT * FROM (SELECT * EXCLUDE (r_onset) FROM fin) JOIN on12 USING (symbol, e0) JOIN m7 USING (symbol, e0)) SELECT " + ", ".join(c if c in EXACT or c.endswith(("_event", "_complete")) else f"round({c}, 6) AS {c}" for c in ALL) + ", round(r_onset, 6) AS intensity, oi_base_n >= 11 AS base_ok, oi_trough_n >= 24 AS trough_ok FROM all12")
def m12(spark, d):
    return _study(spark, d)


@query("a1_class_table", f"{MEAS} SELECT klass, count(*) AS n, count(*) FILTER (symbol = 'BTC') AS n_btc, count(*) FILTER (symbol = 'ETH') AS n_eth, round(quantile_cont(disp, 0.5), 6) AS med_disp, round(quantile_cont(doi, 0.5), 6) AS med_doi, round(quantile_cont(reversion, 0.5), 6) AS med_reversion, round(avg(rec_event::int), 6) AS recovered, round(avg((NOT rec_complete)::int), 6) AS incomplete FROM fin WHERE analysable GROUP BY 1")
def a1(spark, d):
    return study.class_table(_study(spark, d))


@query("a3_cluster_summary", f"{calm(MEAS)}, ep AS ({ISL.format(n='ep', g=405 * M)}), c AS (SELECT ep, count(*) AS n, count(*) FILTER (klass = 'contraction') AS a, count(*) FILTER (klass = 'limited') AS b FROM fin JOIN ep USING (symbol, e0) WHERE analysable AND klass IN ('contraction', 'limited') GROUP BY 1) SELECT coalesce(sum(n), 0)::bigint AS n, count(*) AS g, count(*) FILTER (a > 0 AND b > 0) AS g_mixed, count(*) FILTER (a > 0) AS g_contraction, count(*) FILTER (b > 0) AS g_limited, max(n) AS max_size, quantile_cont(n, 0.5) AS median_size FROM c")
def a3(spark, d):
    return study.cluster_summary(study.clustered(_study(spark, d, calm=True)))


@query("a11_waterfall", f"{TRIG} SELECT symbol, count(*) FILTER (trigger) AS triggers, (SELECT count(*) FROM ons WHERE ons.symbol = t.symbol) AS onsets FROM trig t GROUP BY 1")
def a11(spark, d):
    t = staged(clock.triggers(src.fills(spark, d), P))
    n = clock.onsets(t, P).groupBy("symbol").agg(F.count("*").alias("onsets"))
    return t.groupBy("symbol").agg(F.count_if(F.col("trigger")).alias("triggers")).join(n, "symbol")


@query("g1_quantile_grid", " UNION ALL ".join(f"SELECT * FROM (WITH {trig_sql(q, quiet)} SELECT '{name}' AS spec, symbol, count(*) AS onsets FROM ons GROUP BY symbol)" for name, q, quiet in (("Primary", 0.99, 120), ("S2", 0.95, 120), ("S13a", 0.99, 60), ("S13b", 0.99, 180))))
def g1(spark, d):
    changes = {"Primary": {}, "S2": {"quantile": 0.95}, "S13a": {"quiet_min": 60}, "S13b": {"quiet_min": 180}}
    return grid.onset_counts({"base": src.fills(spark, d)}, [grid.Spec(name, P.but(**c)) for name, c in changes.items()])


def spec_sql(name: str, where: str = "true", q: float = 0.99, quiet: int = 120, warm: int = 7) -> str:
    sql = trig_sql(q, quiet).replace(f"+ {2 * W + 7 * D} AS from_e", f"+ {2 * W + warm * D} AS from_e")
    return f"SELECT * FROM (WITH {sql} SELECT '{name}' AS spec, symbol, count(*) AS onsets FROM ons WHERE {where} GROUP BY symbol)"


WEEK = "(SELECT min(c0) FROM cov) + " + str(10 * D)


@query("g1_onset_specs", " UNION ALL ".join((spec_sql("S1", warm=3), spec_sql("S10", f"NOT (e0 >= {WEEK} AND e0 < {WEEK} + {8 * D})"), spec_sql("S11a", "symbol = 'BTC'"), spec_sql("S11b", "symbol = 'ETH'"))))
def g1o(spark, d):
    f = src.fills(spark, d)
    first = src.coverage(f).agg(F.min("c0")).first()[0] + 10 * D
    keep = {"S10": ~F.col("e0").between(first, first + 8 * D - 1), "S11a": F.col("symbol") == "BTC", "S11b": F.col("symbol") == "ETH"}
    plain = staged(clock.onsets(clock.triggers(f, P), P).select("symbol", "e0"))
    early = clock.onsets(clock.triggers(f, P.but(warmup_days=3)), P).select(F.lit("S1").alias("spec"), "symbol")
    for name, rule in keep.items():
        early = early.unionByName(plain.where(rule).select(F.lit(name).alias("spec"), "symbol"))
    return early.groupBy("spec", "symbol").agg(F.count("*").alias("onsets"))


@query("g1_reinstated_spec", f"SELECT * FROM (WITH {trig_sql().replace(FILLS, FILLS.replace('fills AS (', 'all_fills AS (', 1) + ", kept AS (SELECT * FROM all_fills WHERE direction <> 'Close Short'), gp AS (SELECT *, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n_lost FROM kept), fills AS (SELECT * EXCLUDE (n_lost) FROM gp UNION ALL SELECT * EXCLUDE (n_lost, i) FROM (SELECT *, unnest(range(n_lost)) AS i FROM gp WHERE n_lost > 0))")} SELECT 'S9' AS spec, symbol, count(*) AS onsets FROM ons GROUP BY symbol)")
def g1m(spark, d):
    f = src.fills(spark, d).where("direction <> 'Close Short'")
    again = staged(quality.reinstated(f, quality.dropped(f)))
    return clock.onsets(clock.triggers(again, P), P).groupBy("symbol").agg(F.count("*").alias("onsets")).select(F.lit("S9").alias("spec"), "symbol", "onsets")


@query("o4_trigger_differences", f"{TRIG}, {trig_sql(0.95)[len(FILLS) + 2:].replace('cov AS', 'cov2 AS').replace('FROM cov', 'FROM cov2').replace('grid AS', 'grid2 AS').replace('FROM grid g', 'FROM grid2 g').replace('bins AS', 'bins2 AS').replace('FROM bins', 'FROM bins2').replace('roll AS', 'roll2 AS').replace('FROM roll', 'FROM roll2').replace('thr AS (', 'thr2 AS (').replace('FROM thr)', 'FROM thr2)').replace('trig AS', 'trig2 AS').replace('FROM trig', 'FROM trig2').replace('ch0 AS', 'ch20 AS').replace('FROM ch0', 'FROM ch20').replace('ch AS', 'ch2 AS').replace('FROM ch ', 'FROM ch2 ').replace('ons AS', 'ons2 AS')} SELECT coalesce(a.symbol, b.symbol) AS symbol, count(*) FILTER (b.e IS NULL) AS only_a, count(*) FILTER (a.e IS NULL) AS only_b FROM (SELECT symbol, e FROM trig WHERE trigger) a FULL JOIN (SELECT symbol, e FROM trig2 WHERE trigger) b ON a.symbol = b.symbol AND a.e = b.e GROUP BY 1")
def o4(spark, d):
    f = src.fills(spark, d)
    a, b = (clock.triggers(f, P.but(quantile=q)).where("trigger").select("symbol", "e") for q in (0.99, 0.95))
    only = a.join(b, ["symbol", "e"], "left_anti").select("symbol", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.join(a, ["symbol", "e"], "left_anti").select("symbol", F.lit(0), F.lit(1)))
    return a.union(b).select("symbol").distinct().join(only.groupBy("symbol").agg(F.sum("x").alias("only_a"), F.sum("y").alias("only_b")), "symbol", "left").na.fill(0)


# ---- statistics, over orders and line items where many groups are wanted

SURV = "rows_ AS (SELECT l_returnflag AS grp, (l_orderkey % 97) AS cl, l_quantity AS d, l_linestatus = 'F' AS ev FROM lineitem WHERE l_returnflag IN ('A', 'N'))"


def survival(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").where(F.col("l_returnflag").isin("A", "N"))
    return li.select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") % 97).alias("cl"), F.col("l_quantity").alias("d"), (F.col("l_linestatus") == "F").alias("ev"))


KM = f"{SURV}, per AS (SELECT grp, d, count(*) AS n, count(*) FILTER (ev) AS deaths FROM rows_ GROUP BY 1, 2), ar AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY d DESC) AS at_risk FROM per), km AS (SELECT grp, d, at_risk::bigint AS at_risk, deaths, product(1 - deaths / at_risk) OVER (PARTITION BY grp ORDER BY d) AS s FROM ar WHERE deaths > 0)"


@query("k1_kaplan_meier", f"{KM} SELECT grp, d, at_risk, deaths, round(s, 6) AS s FROM km")
def k1(spark, d):
    return stats.kaplan_meier(survival(spark, d))


@query("k2_rmst", f"{KM}, st AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY grp ORDER BY d), 40.0) AS nx FROM km WHERE d < 40) SELECT grp, round(min(d) + sum(s * (nx - d)), 6) AS rmst FROM st GROUP BY grp")
def k2(spark, d):
    s = survival(spark, d)
    return stats.rmst(stats.kaplan_meier(s), s.select("grp").distinct(), 40.0)


LR = f"{SURV}, per AS (SELECT d, count(*) AS c, count(*) FILTER (grp = 'A') AS c1, count(*) FILTER (ev) AS dd, count(*) FILTER (ev AND grp = 'A') AS d1 FROM rows_ GROUP BY 1), t AS (SELECT d, dd, d1, sum(c) OVER (ORDER BY d DESC) AS n, sum(c1) OVER (ORDER BY d DESC) AS n1 FROM per)"


@query("k4_logrank", f"{LR}, x AS (SELECT sum(d1 - dd * n1 / n) AS u, sum(CASE WHEN n > 1 THEN dd * (n1 / n) * (1 - n1 / n) * (n - dd) / (n - 1) ELSE 0 END) AS v FROM t WHERE dd > 0) SELECT round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chi2, round({chi_square_sql('u * u / v')}, 6) AS p FROM x")
def k4(spark, d):
    return stats.log_rank(survival(spark, d), "A")


@query("k4_robust_logrank", f"{LR}, h AS (SELECT d, n1 / n AS zbar, sum(dd / n) OVER (ORDER BY d) AS h, sum(dd / n * (n1 / n)) OVER (ORDER BY d) AS hz FROM t), w AS (SELECT cl, sum(CASE WHEN ev THEN (grp = 'A')::int - zbar ELSE 0 END - ((grp = 'A')::int * h - hz)) AS w FROM rows_ JOIN h USING (d) GROUP BY cl) SELECT round(sum(w), 4) AS u, round(sum(w * w), 4) AS v, round(sum(w) * sum(w) / sum(w * w), 4) AS chi2, round({chi_square_sql('y')}, 4) AS p FROM w, (SELECT sum(w) * sum(w) / sum(w * w) AS y FROM w) GROUP BY y")
def k4r(spark, d):
    return stats.robust_log_rank(survival(spark, d), "A", "cl").select(*[F.round(c, 4).alias(c) for c in ("u", "v", "chi2", "p")])


def regression(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5).alias("y"), (F.col("o_custkey") % 13 / 13.0).alias("x"), (F.col("o_orderkey") % 41).alias("cl"), (F.col("o_orderstatus") == "F").alias("flag"))


REG = "reg AS (SELECT o_orderkey AS id, o_totalprice / 1e5 AS y, (o_custkey % 13) / 13.0::double AS x, o_orderkey % 41 AS cl, o_orderstatus = 'F' AS flag FROM orders)"


@query("r1_ols", f"{REG} SELECT round(regr_intercept(y, x), 6) AS b0, round(regr_slope(y, x), 6) AS b1 FROM reg")
def r1(spark, d):
    b, _ = stats.ols(regression(spark, d), "y", ["x"])
    return spark.createDataFrame([tuple(b)], "b0 double, b1 double")


@query("r2_cr1", f"{REG}, f AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, avg(x) AS mx, var_pop(x) * count(*) AS sxx, count(*) AS n FROM reg), c AS (SELECT cl, sum((x - mx) / sxx * (y - b0 - b1 * x)) AS s, sum((x - mx) / sxx) AS w FROM reg, f GROUP BY cl), a AS (SELECT sum(s * s) AS ss, count(*) AS g, var_pop(w * w) AS gv, avg(w * w) AS gm FROM c) SELECT round(b1, 6) AS coef, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * ss), 6) AS se, g, round(g / (1 + gv / (gm * gm)), 4) AS g_eff, n FROM a, f")
def r2(spark, d):
    return stats.cr1(regression(spark, d), "y", ["x"], "cl").withColumn("g_eff", F.round("g_eff", 4))


def digest_sql(*parts: str) -> str:
    return "concat('0x', substr(md5(" + " || ':' || ".join(f"({p})::varchar" for p in parts) + "), 1, 8))::bigint"


WILD = f"""{REG}, f AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, count(*) AS n FROM reg),
c AS (SELECT cl, sum((x - mx) / sxx * (y - b0 - b1 * x)) AS o, sum((x - mx) / sxx * (y - my)) AS q, sum((1.0 / n - mx * (x - mx) / sxx) * (y - my)) AS q0, sum((x - mx) / sxx) AS w, sum((x - mx) / sxx * x) AS wx FROM reg, f GROUP BY cl),
v AS (SELECT b, c.*, ([-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)])[{digest_sql('7', 'b', 'cl')} % 6 + 1] AS v FROM c, range(1, 200) z(b)),
h AS (SELECT b, sum(v * q0) AS d0, sum(v * q) AS d1 FROM v GROUP BY b),
ts AS (SELECT b, max(d1) / sqrt(sum((v * q - w * d0 - wx * d1) ** 2)) AS t FROM v JOIN h USING (b) GROUP BY b),
t0 AS (SELECT max(b1) / sqrt(sum(o * o)) AS t0 FROM c, f)"""


@query("r4_wild_bootstrap", f"{WILD} SELECT 0.0::double AS beta0, round(t0, 6) AS t0, round(avg((abs(t) >= abs(t0))::int), 6) AS p FROM ts, t0 GROUP BY t0")
def r4(spark, d):
    return stats.wild_bootstrap(spark, regression(spark, d), "y", ["x"], "cl", 199)


@query("r5_bootstrap_interval")
def r5(spark, d):
    return stats.wild_interval(spark, regression(spark, d), "y", ["x"], "cl", 9999)


@query("r6_regression_report")
def r6q(spark, d):
    return stats.regression_report(spark, regression(spark, d), "y", ["x"], "cl", 9999)


BOOT = f"{REG}, s AS (SELECT b, ({digest_sql('11', 'b', 'slot')}) % 41 AS cl FROM range(1, 100) x(b), range(0, 41) z(slot)), q AS (SELECT b, cl, count(*) AS freq FROM s GROUP BY 1, 2), e AS (SELECT b, y, flag FROM reg JOIN q ON q.cl = reg.cl, range(0, freq))"


@query("r8_median_diff", f"{BOOT}, d AS (SELECT b, quantile_cont(y, 0.5) FILTER (flag) - quantile_cont(y, 0.5) FILTER (NOT flag) AS d FROM e GROUP BY b) SELECT (SELECT count(*) FROM reg WHERE flag) AS n1, (SELECT count(*) FROM reg WHERE NOT flag) AS n2, round((SELECT quantile_cont(y, 0.5) FILTER (flag) - quantile_cont(y, 0.5) FILTER (NOT flag) FROM reg), 6) AS est, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, count(d) AS used FROM d")
def r8(spark, d):
    r = regression(spark, d).withColumn("g", F.when(F.col("flag"), "a").otherwise("b"))
    return stats.median_difference(spark, r, "y", "g", "a", "b", "cl", 99)


@query("r9_permutation", f"{REG}, k AS (SELECT id, y, flag FROM reg), n AS (SELECT count(*) FILTER (flag) AS n1, avg(y) FILTER (flag) - avg(y) FILTER (NOT flag) AS est FROM k), o AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY {digest_sql('3', 'b', 'id')}, id) AS o FROM k, range(1, 100) x(b)), r AS (SELECT b, avg(y) FILTER (o <= n1) - avg(y) FILTER (o > n1) AS d FROM o, n GROUP BY b) SELECT round(max(est), 6) AS est, round((count(*) FILTER (abs(d) >= abs(est)) + 1) / (count(*) + 1), 6) AS p FROM r, n")
def r9(spark, d):
    return stats.permutation(spark, regression(spark, d), "y", "flag", 99)


@query("r11_spearman", f"{REG}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM reg) SELECT round(corr(rx, ry), 6) AS rho FROM k")
def r11(spark, d):
    return study.spearman(regression(spark, d), "x", "y")


def dealt_sql(value: str, other: str, draws: int = 49) -> str:
    """``value`` of the rows of k dealt anew in draws 1 to ``draws`` and kept in draw 0; other columns stay."""
    return f"pl AS (SELECT b, k.*, row_number() OVER (PARTITION BY b ORDER BY {digest_sql('3', 'b', 'id')}, id) AS place FROM k, range(0, {draws + 1}) z(b)), sh AS (SELECT p.b, {', '.join('p.' + c for c in other.split())}, o.{value} FROM pl p JOIN pl o ON o.b = 0 AND o.place = p.place)"


TWO_SIDED = "SELECT round(max(e.d), 6) AS est, round((count(*) FILTER (r.b > 0 AND abs(r.d) >= abs(e.d)) + 1) / count(*), 6) AS p, max(e.n) AS n FROM dr r, dr e WHERE e.b = 0"
RANKS = "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry"


@query("r11_spearman_permutation", f"{REG}, k AS (SELECT id, {RANKS} FROM reg), {dealt_sql('ry', 'rx')}, dr AS (SELECT b, corr(rx, ry) AS d, count(*) AS n FROM sh GROUP BY b) {TWO_SIDED}")
def r11p(spark, d):
    return stats.spearman_permutation(regression(spark, d), "x", "y", 49)


SLOPE = "(covar_pop(x, y) * var_pop(c) - covar_pop(x, c) * covar_pop(c, y)) / (var_pop(x) * var_pop(c) - covar_pop(x, c) * covar_pop(x, c))"


@query("r10_slope_permutation", f"{REG}, k AS (SELECT id, y, x, flag::int::double AS c FROM reg), {dealt_sql('x', 'y c')}, dr AS (SELECT b, {SLOPE} AS d, count(*) AS n FROM sh GROUP BY b) {TWO_SIDED}")
def r10s(spark, d):
    return stats.slope_permutation(regression(spark, d).withColumn("c", F.col("flag").cast("double")), "y", "x", "c", 49)


@query("m20_economic", f"{DENSE}, {BARS}, c AS (SELECT symbol, bar // {D} AS d, arg_max(close, bar) AS close FROM bars GROUP BY 1, 2), r AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY d)) AS r FROM c) SELECT symbol, round(stddev_samp(r), 6) AS vol, round(quantile_cont(abs(r), 0.5), 6) AS median_abs FROM r GROUP BY 1")
def m20(spark, d):
    return study.economic(src.bars(src.dense(spark, d)))


# ---- the superseded track

LOUT = f"""{LEGACY}, {DENSE[len(COV) + 2:]}, {BARS}, lo AS (SELECT symbol, min(e) AS t0, max(e) AS t1 FROM lc GROUP BY symbol, chain),
og AS (SELECT b.*, d.oi FROM bars b LEFT JOIN dense d ON d.symbol = b.symbol AND d.t = b.bar),
o1 AS (SELECT lo.symbol, t0, t1, CASE WHEN min(close) FILTER (bar BETWEEN t0 - {30 * M} AND t0 - {5 * M}) = max(close) FILTER (bar BETWEEN t0 - {30 * M} AND t0 - {5 * M}) THEN min(close) FILTER (bar BETWEEN t0 - {30 * M} AND t0 - {5 * M}) ELSE avg(close) FILTER (bar BETWEEN t0 - {30 * M} AND t0 - {5 * M}) END AS p0, min(low) FILTER (bar >= t0) AS low, arg_min(bar, (low, bar)) FILTER (bar >= t0) AS trough, avg(oi) FILTER (bar <= t0) AS b, min(oi) FILTER (bar >= t0) AS l FROM lo JOIN og ON og.symbol = lo.symbol AND og.bar BETWEEN t0 - {60 * M} AND t0 + {120 * M} GROUP BY 1, 2, 3),
o2 AS (SELECT o.*, (l - b) / nullif(b, 0) AS doi, ln(low / p0) AS peak_disloc, (SELECT min(bar) FROM bars x WHERE x.symbol = o.symbol AND x.bar BETWEEN coalesce(o.trough, o.t0) AND o.t0 + {1440 * M} AND x.high >= o.p0 * 0.999) AS hit, ln((SELECT arg_min(close, bar) FROM bars x WHERE x.symbol = o.symbol AND x.bar >= o.t0 + {360 * M}) / p0) AS perm_6h, ln((SELECT arg_min(close, bar) FROM bars x WHERE x.symbol = o.symbol AND x.bar >= o.t0 + {1440 * M}) / p0) AS perm_24h FROM o1 o WHERE p0 IS NOT NULL),
o3 AS (SELECT *, count(doi) OVER w AS n_prior, quantile_cont(doi, 0.1) OVER w AS q FROM o2 WINDOW w AS (PARTITION BY symbol ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lout AS (SELECT *, CASE WHEN doi IS NULL THEN 'unknown' WHEN doi <= CASE WHEN n_prior >= 20 THEN q ELSE -0.025 END THEN 'deleverage' WHEN doi > -0.005 THEN 'churn' ELSE 'middle' END AS klass FROM o3)"""
HOUR = f"t0 % {D} // {60 * M}"


def _grid(spark, d) -> tuple[DataFrame, DataFrame]:
    snaps = staged(src.dense(spark, d))
    bars = staged(src.bars(snaps))
    return bars, superseded.bars_with_oi(bars, snaps)


def _old(spark, d, p=P) -> DataFrame:
    return superseded.outcomes(study.legacy_events(src.fills(spark, d), p), _grid(spark, d)[1], p)


@query("m13_legacy_outcomes", f"{LOUT} SELECT symbol, t0, round(p0, 6) AS p0, round(doi, 6) AS doi_event, round(peak_disloc, 6) AS peak_disloc, round(coalesce((hit - t0) / {M}.0, 1440.0), 6)::double AS ttr_min, hit IS NULL AS censored, {r6('perm_6h', 'perm_24h')}, round(CASE WHEN perm_6h IS NOT NULL AND peak_disloc <> 0 THEN least(1.0, greatest(0.0, 1 - perm_6h / peak_disloc)) END, 6) AS transitory_share, CASE WHEN {HOUR} < 8 THEN 'asia' WHEN {HOUR} < 13 THEN 'eu' WHEN {HOUR} < 17 THEN 'eu_us_overlap' ELSE 'us' END AS session FROM lout")
def m13(spark, d):
    return _old(spark, d).select("symbol", "t0", "p0", "doi_event", "peak_disloc", "ttr_min", "censored", "perm_6h", "perm_24h", "transitory_share", "session")


@query("m15_legacy_classes", f"{LOUT} SELECT symbol, t0, klass FROM lout")
def m15(spark, d):
    return _old(spark, d).select("symbol", "t0", "klass")


@query("m10_fixed_classes", f"{LOUT} SELECT symbol, t0, CASE WHEN doi IS NULL THEN 'unknown' WHEN doi <= -0.025 THEN 'deleverage' WHEN doi > -0.005 THEN 'churn' ELSE 'middle' END AS klass FROM lout")
def m10(spark, d):
    return _old(spark, d, P.but(rule="fixed")).select("symbol", "t0", "klass")


@query("a2_legacy_summary", f"{LOUT} SELECT klass, count(*) AS n, round(quantile_cont(peak_disloc, 0.5), 6) AS med_peak, round(quantile_cont(doi, 0.5), 6) AS med_doi, round(avg((hit IS NULL)::int), 6) AS censored FROM lout GROUP BY 1")
def a2(spark, d):
    med = lambda c, name: F.expr(f"percentile({c}, 0.5D)").alias(name)
    return _old(spark, d).groupBy("klass").agg(F.count("*").alias("n"), med("peak_disloc", "med_peak"), med("doi_event", "med_doi"), F.avg(F.col("censored").cast("int")).alias("censored"))


PROTO = f"""{DENSE}, {BARS}, pg AS (SELECT b.symbol, b.bar AS e, oi / lag(oi, 12) OVER w - 1 AS doi, ln(close / lag(close, 12) OVER w) AS ret FROM bars b LEFT JOIN dense d ON d.symbol = b.symbol AND d.t = b.bar WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar)),
pt AS (SELECT *, CASE WHEN count(doi) OVER w >= 2000 THEN quantile_cont(doi, 0.05) OVER w END AS a, CASE WHEN count(ret) OVER w >= 2000 THEN quantile_cont(ret, 0.2) OVER w END AS b FROM pg WINDOW w AS (PARTITION BY symbol ORDER BY e RANGE BETWEEN {7 * D - 1} PRECEDING AND CURRENT ROW)),
pn AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY symbol ORDER BY e) <= {120 * M} THEN 0 ELSE 1 END AS new FROM pt WHERE doi <= a AND ret <= b), pc AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY e) AS chain FROM pn), ps AS (SELECT symbol, min(e) AS t0, max(e) AS t1 FROM pc GROUP BY symbol, chain)"""


@query("c5_prototype_events", f"{PROTO} SELECT ps.symbol, t0, t1, round(min(doi), 6) AS doi_trigger, round(min(ret), 6) AS ret_trigger FROM ps JOIN pg ON pg.symbol = ps.symbol AND pg.e BETWEEN t0 AND t1 GROUP BY 1, 2, 3")
def c5(spark, d):
    # a month of sparse snapshots: wider tails than the prototype's 1 % and 5 %, and a trail that may lack its first bars
    return superseded.prototype_events(_grid(spark, d)[1], P, oi_q=0.05, ret_q=0.2, least=2000)


PROTO_OUT = f"{PROTO}, lo AS (SELECT ps.symbol, t0, t1, min(doi) AS doi_trigger, min(ret) AS ret_trigger FROM ps JOIN pg ON pg.symbol = ps.symbol AND pg.e BETWEEN t0 AND t1 GROUP BY 1, 2, 3), {LOUT[LOUT.index('og AS ('):]}"


@query("m14_prototype_outcomes", f"{PROTO_OUT} SELECT symbol, t0, {r6('p0', 'doi_trigger', 'ret_trigger')}, round(doi, 6) AS doi_event, round(peak_disloc, 6) AS peak_disloc, round(coalesce((hit - t0) / {M}.0, 1440.0), 6)::double AS ttr_min, hit IS NULL AS censored, {r6('perm_6h', 'perm_24h')}, round(CASE WHEN perm_6h IS NOT NULL AND peak_disloc <> 0 THEN least(1.0, greatest(0.0, 1 - perm_6h / peak_disloc)) END, 6) AS transitory_share, CASE WHEN {HOUR} < 7 THEN 'asia' WHEN {HOUR} < 13 THEN 'eu' ELSE 'us' END AS session FROM lout JOIN lo USING (symbol, t0)")
def m14(spark, d):
    grid = staged(_grid(spark, d)[1])
    ev = superseded.prototype_events(grid, P, oi_q=0.05, ret_q=0.2, least=2000)
    return superseded.prototype_outcomes(ev, grid, P).select("symbol", "t0", "p0", "doi_trigger", "ret_trigger", "doi_event", "peak_disloc", "ttr_min", "censored", "perm_6h", "perm_24h", "transitory_share", "session")


@query("m16_validators", f"{LEGACY}, {DENSE[len(COV) + 2:]}, {BARS}, lo AS (SELECT symbol, min(e) AS t0 FROM lc GROUP BY symbol, chain), pv AS (SELECT lo.symbol, t0, ln(close / lag(close) OVER (PARTITION BY lo.symbol, t0 ORDER BY bar)) AS r FROM lo JOIN bars b ON b.symbol = lo.symbol AND b.bar BETWEEN t0 + {120 * M} AND t0 + {720 * M}), vol AS (SELECT symbol, t0, CASE WHEN count(r) > 3 THEN stddev_samp(r) END AS v FROM pv GROUP BY 1, 2) SELECT lo.symbol, lo.t0, coalesce((SELECT sum(notional) > 0 FROM fills f WHERE f.symbol = lo.symbol AND f.side = 'buy' AND f.t BETWEEN lo.t0 AND lo.t0 + {120 * M}), false) AS adl, round(1e6 * ((SELECT avg(funding) FROM fills f WHERE f.symbol = lo.symbol AND f.t BETWEEN lo.t0 AND lo.t0 + {120 * M}) - (SELECT avg(funding) FROM fills f WHERE f.symbol = lo.symbol AND f.t BETWEEN lo.t0 - {60 * M} AND lo.t0)), 6) AS funding_swing_ppm, round(v, 6) AS post_vol FROM lo LEFT JOIN vol ON vol.symbol = lo.symbol AND vol.t0 = lo.t0")
def m16(spark, d):
    f = src.fills(spark, d)
    v = superseded.validators(study.legacy_events(f, P), f.where("side = 'buy'"), src.snapshots(spark, d), _grid(spark, d)[0])
    return v.select("symbol", "t0", "adl", (F.col("funding_swing") * 1e6).alias("funding_swing_ppm"), "post_vol")


MEMBER = f"""WITH leg AS (WITH {LOUT} SELECT symbol, t0, t1, klass FROM lout), cor AS (WITH {MEAS} SELECT symbol, e0, klass, analysable, reason FROM fin), tt AS (WITH {TRIG} SELECT symbol, e, eligible, trigger FROM trig),
best AS (SELECT l.symbol, l.t0, arg_min(c.e0, (c.e0 <> l.t0 + {5 * M}, c.e0)) AS e0 FROM leg l JOIN cor c ON c.symbol = l.symbol AND c.e0 BETWEEN l.t0 - {120 * M} AND l.t1 + {10 * M} GROUP BY 1, 2),
why AS (SELECT l.symbol, l.t0, bool_or(eligible) AS el, bool_or(trigger) AS tr FROM leg l JOIN tt ON tt.symbol = l.symbol AND tt.e BETWEEN l.t0 + {5 * M} AND l.t1 + {5 * M} GROUP BY 1, 2),
mem AS (SELECT l.symbol, l.t0 AS legacy_t0, l.klass AS legacy_class, CASE WHEN b.e0 IS NULL THEN 'dropped' WHEN b.e0 = l.t0 + {5 * M} THEN 'same onset bin' ELSE 'onset shifted' END AS status, b.e0, c.klass AS corrected_class, coalesce(c.analysable, false) AS analysable, CASE WHEN b.e0 IS NOT NULL THEN c.reason WHEN NOT coalesce(el, false) THEN 'before full warm-up' WHEN NOT tr THEN 'no bin exceeds prior-only threshold' ELSE 'absorbed into an earlier corrected chain' END AS exclusion, CASE WHEN b.e0 <> l.t0 + {5 * M} THEN round((b.e0 - l.t0 - {5 * M}) / {M}.0, 6) END::double AS shift_min
FROM leg l LEFT JOIN best b ON b.symbol = l.symbol AND b.t0 = l.t0 LEFT JOIN cor c ON c.symbol = b.symbol AND c.e0 = b.e0 LEFT JOIN why w ON w.symbol = l.symbol AND w.t0 = l.t0
UNION ALL SELECT symbol, NULL, NULL, 'new in corrected', e0, klass, analysable, reason, NULL FROM cor c WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.symbol = c.symbol AND b.e0 = c.e0))"""


def _members(spark, d, symbol_blind: bool = False) -> DataFrame:
    table = staged(clock.triggers(src.fills(spark, d), P))
    return superseded.membership(_old(spark, d).select("symbol", "t0", "t1", "klass"), _study(spark, d), table, P, symbol_blind)


@query("g6_membership", f"{MEMBER} SELECT * FROM mem")
def g6(spark, d):
    return _members(spark, d)


@query("g6_symbol_blind", f"{MEMBER.replace('b.symbol = c.symbol AND b.e0 = c.e0)', 'b.e0 = c.e0)')} SELECT status, count(*) AS n FROM mem GROUP BY 1")
def g6b(spark, d):
    return _members(spark, d, symbol_blind=True).groupBy("status").agg(F.count("*").alias("n"))


@query("a7_membership_summary", f"{MEMBER} SELECT status, exclusion, count(*) AS n FROM mem GROUP BY 1, 2")
def a7(spark, d):
    return _members(spark, d).groupBy("status", "exclusion").agg(F.count("*").alias("n"))


@query("c9_clusters", f"{TRIG}, e6 AS ({ISL.format(n='ep6', g=405 * M)}), e24 AS ({ISL.format(n='ep24', g=1485 * M)}) SELECT symbol, e0, ep6::bigint AS ep6, ep24::bigint AS ep24, strftime(make_timestamp(e0), '%Y-%m-%d') AS day, strftime(make_timestamp(e0), '%G-W%V') AS week, symbol || ':' || e0 AS \"none\" FROM e6 JOIN e24 USING (symbol, e0)")
def c9(spark, d):
    return study.clustered(clock.onsets(clock.triggers(src.fills(spark, d), P), P).select("symbol", "e0"))


# ---- streams, drained over what is there


@query("t1s_stream_bins", f"{FILLS}, w AS (SELECT symbol, t // {W} * {W} + {W} AS e, sum(notional) AS notional, count(*) AS n FROM fills WHERE side = 'sell' GROUP BY 1, 2) SELECT symbol, e, round(notional, 6) AS notional, n FROM w WHERE e <= (SELECT max(t) // 1000 * 1000 - {10 * M} FROM fills WHERE side = 'sell')")
def t1s(spark, d):
    return live.drained(live.right_bins(src.fill_stream(spark, d), P))


@query("t2s_stream_chains", f"{TRIG} SELECT symbol, e0, chain_end, n_triggers_chain FROM ons WHERE chain_end + {120 * M} <= (SELECT max(e) - {10 * M} FROM trig WHERE trigger)")
def t2s(spark, d):
    t = clock.triggers(src.fills(spark, d), P).where("trigger").select("symbol", "e")
    return live.drained(live.onset_sessions(live.as_stream(t), P))


@query("t3s_stream_triggers", f"{TRIG} SELECT symbol, e, {r6('r', 'thr')}, trigger FROM trig WHERE r IS NOT NULL")
def t3s(spark, d):
    rolled = clock.rolled(clock.bins(src.fills(spark, d), P), P).select("symbol", "e", "r")
    return live.drained(live.trailing_triggers(live.as_stream(rolled), P))


# ---- replicates of survival and regression


KB = f"{SURV}, s AS (SELECT b, ({digest_sql('11', 'b', 'slot')}) % 97 AS cl FROM range(1, 50) x(b), range(0, 97) z(slot)), q AS (SELECT b, cl, count(*) AS freq FROM s GROUP BY 1, 2 UNION ALL SELECT 0, cl, 1 FROM (SELECT DISTINCT cl FROM rows_)), per AS (SELECT b, grp, d, sum(freq) AS n, coalesce(sum(freq) FILTER (ev), 0) AS deaths FROM rows_ JOIN q USING (cl) GROUP BY 1, 2, 3), ar AS (SELECT *, sum(n) OVER (PARTITION BY b, grp ORDER BY d DESC) AS at_risk FROM per), km AS (SELECT b, grp, d, product(1 - deaths / at_risk) OVER (PARTITION BY b, grp ORDER BY d) AS s FROM ar WHERE deaths > 0), st AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY b, grp ORDER BY d), 40.0) AS nx FROM km WHERE d < 40), rm AS (SELECT b, grp, min(d) + sum(s * (nx - d)) AS rmst FROM st GROUP BY 1, 2), df AS (SELECT b, max(rmst) FILTER (grp = 'A') - max(rmst) FILTER (grp = 'N') AS d FROM rm GROUP BY b)"


@query("k3_rmst_difference", f"{KB} SELECT round(max(d) FILTER (b = 0), 6) AS est, round(quantile_cont(d, 0.025) FILTER (b > 0), 6) AS lo, round(quantile_cont(d, 0.975) FILTER (b > 0), 6) AS hi FROM df")
def k3(spark, d):
    return stats.rmst_difference(spark, survival(spark, d), "A", "N", "cl", 40.0, 49)


@query("k5_stratified_logrank", "r0 AS (SELECT l_returnflag AS grp, l_quantity AS d, l_linestatus = 'F' AS ev, l_extendedprice AS size FROM lineitem WHERE l_returnflag IN ('A', 'N')), r1 AS (SELECT *, CASE WHEN size <= (SELECT quantile_cont(size, 0.5) FROM r0) THEN 'small' ELSE 'large' END AS stratum FROM r0), per AS (SELECT stratum, d, count(*) AS c, count(*) FILTER (grp = 'A') AS c1, count(*) FILTER (ev) AS dd, count(*) FILTER (ev AND grp = 'A') AS d1 FROM r1 GROUP BY 1, 2), t AS (SELECT stratum, d, dd, d1, sum(c) OVER w AS n, sum(c1) OVER w AS n1 FROM per WINDOW w AS (PARTITION BY stratum ORDER BY d DESC)), x AS (SELECT stratum, sum(d1 - dd * n1 / n) AS u, sum(CASE WHEN n > 1 THEN dd * (n1 / n) * (1 - n1 / n) * (n - dd) / (n - 1) ELSE 0 END) AS v FROM t WHERE dd > 0 GROUP BY 1) SELECT stratum, round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chi2, round(" + chi_square_sql("u * u / v") + ", 6) AS p FROM x")
def k5(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").where(F.col("l_returnflag").isin("A", "N"))
    return stats.stratified_log_rank(li.select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("d"), (F.col("l_linestatus") == "F").alias("ev"), F.col("l_extendedprice").alias("size")), "A", "size")


COEF = "(covar_pop({x}, y) * var_pop(c) - covar_pop({x}, c) * covar_pop(c, y)) / (var_pop({x}) * var_pop(c) - covar_pop({x}, c) * covar_pop({x}, c))"


@query("r10_ols_permutation", f"{REG}, k AS (SELECT id, y, x AS c, flag::int::double AS f FROM reg), n AS (SELECT sum(f) AS n1, {COEF.format(x='f')} AS est FROM k), o AS (SELECT b, y, c, row_number() OVER (PARTITION BY b ORDER BY {digest_sql('3', 'b', 'id')}, id) AS o FROM k, range(1, 50) x(b)), l AS (SELECT b, y, c, (o <= n1)::int::double AS z FROM o, n), r AS (SELECT b, {COEF.format(x='z')} AS d FROM l GROUP BY b) SELECT round(max(est), 6) AS est, round((count(*) FILTER (abs(d) >= abs(est)) + 1) / (count(*) + 1), 6) AS p FROM r, n")
def r10(spark, d):
    return stats.ols_permutation(regression(spark, d), "y", "flag", "x", 49)


@query("f6_date_exclusion", "SELECT count(*) AS n, count(*) FILTER (o_orderdate >= '1995-10-10' AND o_orderdate < '1995-10-18') AS excluded, count(*) FILTER (NOT (o_orderdate >= '1995-10-10' AND o_orderdate < '1995-10-18')) AS kept FROM orders")
def f6(spark, d):
    inside = F.expr("o_orderdate >= timestamp_ntz'1995-10-10' and o_orderdate < timestamp_ntz'1995-10-18'")
    return spark.read.parquet(f"{d}/orders.parquet").agg(F.count("*").alias("n"), F.count_if(inside).alias("excluded"), F.count_if(~inside).alias("kept"))


# ---- audit and description


@query("s3_asset_context", f"{FILLS}, r AS (SELECT symbol, t, CASE WHEN direction <> 'Liquidated Isolated Long' THEN oi END AS oi, CASE WHEN direction = 'Close Long' THEN 100 + notional / 50 END AS mid, CASE WHEN direction <> 'Liquidated Cross Long' THEN 100 + notional / 40 END AS mark, 100 + notional / 30 AS oracle FROM fills) SELECT symbol, count(*) AS n, round(sum(oi), 4) AS oi, round(sum(coalesce(mid, mark, oracle)), 4) AS px FROM r WHERE oi IS NOT NULL GROUP BY 1")
def s3(spark, d):
    f = src.fills(spark, d)
    kind, v = F.col("direction"), F.col("notional")
    raw = f.select(F.col("symbol").alias("Coin"), F.col("t").cast("string").alias("time"), F.when(kind == "Liquidated Isolated Long", "n/a").otherwise((1000 + 10 * v).cast("string")).alias("openInterest"), F.when(kind == "Close Long", (100 + v / 50).cast("string")).alias("midPx"), F.when(kind != "Liquidated Cross Long", 100 + v / 40).alias("mark_px"), (100 + v / 30).alias("oracle_px"))
    return context.asset_context(raw).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("oi"), 4).alias("oi"), F.round(F.sum("px"), 4).alias("px"))


@query("s6_fill_kinds", f"{FILLS}, r AS (SELECT 'liquidations' AS kind, * FROM fills UNION ALL SELECT 'adl', * FROM fills WHERE direction = 'Close Short') SELECT kind, symbol, count(*) AS n, round(sum(px * sz), 4) AS notional FROM r WHERE direction <> 'Liquidated Isolated Long' GROUP BY 1, 2")
def s6(spark, d):
    f = src.fills(spark, d)
    raw = f.select(F.col("t").cast("string").alias("timestamp"), F.col("symbol").alias("coin"), "side", "direction", F.when(F.col("direction") == "Liquidated Isolated Long", "").otherwise(F.col("px").cast("string")).alias("price"), F.col("sz").cast("string").alias("size"), "is_liquidation")
    return context.reservoir_fills(raw).groupBy("kind", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 4).alias("notional"))


@query("s13_symbol_days", f"{FILLS} SELECT symbol, t // {D} AS d, count(*) AS n FROM fills GROUP BY 1, 2")
def s13d(spark, d):
    return src.fills(spark, d).groupBy("symbol", F.floor(F.col("t") / D).alias("d")).agg(F.count("*").alias("n"))


@query("a5_value_counts", f"{FILLS} SELECT 'side' AS field, side AS value, count(*) AS n FROM fills GROUP BY side UNION ALL SELECT 'direction', direction, count(*) FROM fills GROUP BY direction UNION ALL SELECT 'symbol', symbol, count(*) FROM fills GROUP BY symbol")
def a5(spark, d):
    return audit.value_counts(src.fills(spark, d), ["side", "direction", "symbol"])


@query("f2_fallback_sells", f"{FILLS}, s AS (SELECT * REPLACE (CASE WHEN symbol = 'ETH' THEN 'none' ELSE side END AS side) FROM fills), c AS (SELECT symbol, bool_or(lower(side) IN ('sell', 'a', 'ask')) AS plain FROM s GROUP BY 1) SELECT s.symbol, count(*) AS n, round(sum(notional), 4) AS notional FROM s JOIN c ON c.symbol = s.symbol WHERE CASE WHEN plain THEN lower(side) IN ('sell', 'a', 'ask') ELSE contains(lower(direction), 'long') END GROUP BY 1")
def f2b(spark, d):
    f = src.fills(spark, d).withColumn("side", F.when(F.col("symbol") == "ETH", "none").otherwise(F.col("side")))
    return quality.permissive_sells(f).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 4).alias("notional"))


@query("a9_dropped_by_month", f"{FILLS}, k AS (SELECT * FROM fills WHERE direction <> 'Close Short'), g AS (SELECT t, lead(ingest_idx) OVER (ORDER BY ingest_idx) - ingest_idx - 1 AS n FROM k) SELECT strftime(make_timestamp(t), '%Y-%m') AS month, sum(n)::bigint AS n_dropped FROM g WHERE n > 0 GROUP BY 1")
def a9d(spark, d):
    drops = quality.dropped(src.fills(spark, d).where("direction <> 'Close Short'"))
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / D).cast("int")), "yyyy-MM")
    return drops.groupBy(month.alias("month")).agg(F.sum("n_dropped").alias("n_dropped"))


@query("m19_gap_ranges", f"{ZERO}, {DENSE[len(COV) + 2:]}, {BARS} SELECT r.symbol, run_start, run_end, round(hours, 6)::double AS hours, round(100 * ln(max(high) / min(low)), 6) AS log_range_pct FROM runs r JOIN bars b ON b.symbol = r.symbol AND b.bar BETWEEN run_start AND run_end WHERE hours >= 0.5 GROUP BY 1, 2, 3, 4")
def m19(spark, d):
    return audit.gap_ranges(clock.zero_runs(src.fills(spark, d), P, 0.5), src.bars(src.dense(spark, d)))


@query("q6_identifiers", f"{FILLS} SELECT symbol, true AS volume_all_null, (SELECT count(*) FROM (DESCRIBE events) WHERE column_name IN ('tid', 'hash', 'user', 'event_id', 'user_id')) AS n_identifiers, count(DISTINCT t // {D}) FILTER (direction = 'Close Short') AS adl_days, min(t // {D}) FILTER (direction = 'Close Short') AS first_adl_day, max(t // {D}) FILTER (direction = 'Close Short') AS last_adl_day FROM fills GROUP BY symbol")
def q6(spark, d):
    n = sum(c in ("tid", "hash", "user", "event_id", "user_id") for c in spark.read.parquet(f"{d}/events.parquet").columns)
    day = F.when(F.col("direction") == "Close Short", F.floor(F.col("t") / D))
    volume = src.bars(src.dense(spark, d)).groupBy("symbol").agg(F.bool_and(F.col("volume").isNull()).alias("volume_all_null"))
    days = src.fills(spark, d).groupBy("symbol").agg(F.lit(n).cast("bigint").alias("n_identifiers"), F.countDistinct(day).alias("adl_days"), F.min(day).alias("first_adl_day"), F.max(day).alias("last_adl_day"))
    return days.join(volume, "symbol")


AUDIT = {"f3_side_check": "bad_side bad_sell bad_buy sell_rows buy_rows", "f4_coverage_bounds": "c0 c1", "a6_duplicate_profile": "n_rows distinct_times shared_rows exact_repeats", "a8_notional_by_side": "sell buy", "q2_grid_gaps": "grid_points missing off_grid max_gap_min", "q3_side_ambiguity": "n_dropped ambiguous_share", "q4_empty_bins": "empty_share", "q5_zero_run_counts": "n_half n_one longest"}


@query("q1_audit", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS metric, round({c}::double, 4) AS value FROM ({ORACLE[q]})" for q, names in AUDIT.items() for c in names.split()) + ")")
def q1(spark, d):
    return audit.long_form([QUERIES[q](spark, d).select("symbol", *names.split()) for q, names in AUDIT.items()]).withColumn("value", F.round("value", 4))


def stage_sql(label: str, inclusive: bool, least: int) -> str:
    frame = f"RANGE BETWEEN {7 * D - 1} PRECEDING AND CURRENT ROW" if inclusive else f"RANGE BETWEEN {7 * D} PRECEDING AND 1 PRECEDING"
    return f"""WITH {bins_sql(label)}, sp AS (SELECT symbol, min(e) AS a, max(e) AS z FROM bins WHERE n > 0 GROUP BY 1), sb AS (SELECT b.* FROM bins b JOIN sp ON sp.symbol = b.symbol AND e BETWEEN a AND z),
sr AS (SELECT symbol, e, sum(notional) OVER (PARTITION BY symbol ORDER BY e RANGE BETWEEN {15 * M - 1} PRECEDING AND CURRENT ROW) AS r FROM sb),
st AS (SELECT *, CASE WHEN count(r) OVER w >= {least} THEN quantile_cont(r, 0.99) OVER w END AS thr FROM sr WINDOW w AS (PARTITION BY symbol ORDER BY e {frame})),
sg AS (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY symbol ORDER BY e) <= {120 * M} THEN 0 ELSE 1 END AS new FROM st WHERE r > 0 AND r >= thr)"""


STEPS = (("left", True, 576), ("right", True, 576), ("right", False, 576), ("right", False, 2016))


@query("b10_stage_triggers", f"{stage_sql('right', True, 576)} SELECT symbol, e FROM sg")
def b10(spark, d):
    return audit.staged_triggers(src.fills(spark, d), P.but(inclusive=True), 2)


@query("a11_waterfall_stages", "WITH w AS (" + " UNION ALL ".join(f"SELECT * FROM ({stage_sql(*s)} SELECT {i}::bigint AS stage, symbol, count(*) AS triggers, sum(new)::bigint AS onsets FROM sg GROUP BY symbol)" for i, s in enumerate(STEPS)) + ") SELECT * FROM w UNION ALL SELECT stage, 'all', sum(triggers)::bigint, sum(onsets)::bigint FROM w GROUP BY stage")
def a11s(spark, d):
    return audit.waterfall(src.fills(spark, d), P, 2)


@query("a11_measured_stage", f"{MEAS}, w AS (SELECT symbol, count(*) AS onsets FROM fin WHERE analysable GROUP BY 1) SELECT 4::bigint AS stage, symbol, onsets FROM w UNION ALL SELECT 4, 'all', coalesce(sum(onsets), 0)::bigint FROM w")
def a11m(spark, d):
    return audit.measured_stage(_study(spark, d))


KMC = f"{MEAS}, rows_ AS (SELECT klass AS grp, rec_min AS d, rec_event AS ev FROM fin WHERE analysable){KM[len(SURV):]}, st AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY grp ORDER BY d), 1320.0) AS nx FROM km WHERE d < 1320), ar2 AS (SELECT grp, min(d) + sum(s * (nx - d)) AS rmst FROM st GROUP BY grp), att AS (SELECT grp, min(s) AS s FROM km WHERE d <= 1320 GROUP BY grp)"


@query("a1_descriptive", f"{KMC}, g AS (SELECT klass, count(*) AS n, 100 * quantile_cont(doi, 0.5) AS median_doi_pct, 100 * quantile_cont(disp, 0.5) AS median_disp_x100, 100 * quantile_cont(p6h, 0.5) AS median_p6h_x100, 100 * quantile_cont(p24h, 0.5) AS median_p24h_x100, count(p24h) AS n_p24h, avg(rec_event::int) AS share_recovered, avg((NOT rec_event AND NOT rec_complete)::int) AS share_incomplete, quantile_cont(r_onset, 0.5) AS median_r_onset FROM fin WHERE analysable GROUP BY 1) SELECT klass, n, {r6('median_doi_pct', 'median_disp_x100', 'median_p6h_x100', 'median_p24h_x100')}, n_p24h, {r6('share_recovered', 'share_incomplete', 'median_r_onset')}, round(coalesce(att.s, 1.0), 6) AS km_unrecovered, round(coalesce(ar2.rmst, 1320.0), 6) AS rmst_min FROM g LEFT JOIN att ON att.grp = g.klass LEFT JOIN ar2 ON ar2.grp = g.klass")
def a1d(spark, d):
    return audit.descriptive(_study(spark, d))


EFF = f"{calm(KMC)}, cx AS (SELECT * FROM fin WHERE analysable AND klass IN ('contraction', 'limited')), " + "vx AS (" + " UNION ALL ".join(f"SELECT '{n}' AS effect, klass, {c} * {k} AS v FROM cx" for n, c, k in audit.EFFECTS) + "), eff AS (SELECT effect, count(*) FILTER (klass = 'contraction') AS n1, count(*) FILTER (klass = 'limited') AS n2, quantile_cont(v, 0.5) FILTER (klass = 'contraction') - quantile_cont(v, 0.5) FILTER (klass = 'limited') AS est FROM vx WHERE v IS NOT NULL GROUP BY 1 UNION ALL SELECT 'E6', (SELECT count(*) FROM cx WHERE klass = 'contraction'), (SELECT count(*) FROM cx WHERE klass = 'limited'), CASE WHEN (SELECT count(DISTINCT klass) FROM cx) = 2 THEN (SELECT coalesce(max(rmst), 1320.0) FROM ar2 WHERE grp = 'contraction') - (SELECT coalesce(max(rmst), 1320.0) FROM ar2 WHERE grp = 'limited') END)"


@query("e_effect_estimates", f"{EFF} SELECT effect, n1, n2, round(est, 6) AS est FROM eff")
def eff(spark, d):
    return audit.effect_estimates(_study(spark, d, calm=True))


@query("a12_effects_row", f"{EFF} SELECT " + ", ".join(f"max({'round(est, 6)' if c == 'est' else c}) FILTER (effect = 'E{i}') AS e{i}_{c}" for i in (1, 3, 4, 5, 6) for c in ("est", "n1", "n2")) + " FROM eff")
def a12(spark, d):
    return audit.flattened(audit.effect_estimates(_study(spark, d, calm=True)))


SIGNS = {"E1": -1, "E3": -1, "E4": -1, "E5": -1, "E6": 1}


@query("e5_verdicts", f"{EFF} SELECT effect, round(est, 6) AS est, CASE WHEN est IS NULL THEN 'not comparable' WHEN sign(est) = CASE WHEN effect = 'E6' THEN 1 ELSE -1 END THEN 'same sign' WHEN est = 0 THEN 'no effect' ELSE 'other sign' END AS verdict FROM eff")
def e5(spark, d):
    return audit.verdicts(audit.effect_estimates(_study(spark, d, calm=True)), SIGNS)


@query("r12_size_diagnostic", f"{MEAS}, a AS (SELECT klass, round(-doi, 9) AS x, round(ln(r_onset), 9) AS y, r_onset FROM fin WHERE analysable AND r_onset > 0), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a) SELECT (SELECT round(corr(rx, ry), 6) FROM k) AS rho, round(quantile_cont(r_onset, 0.5) FILTER (klass = 'contraction'), 6) AS median_contraction, round(quantile_cont(r_onset, 0.5) FILTER (klass = 'limited'), 6) AS median_limited FROM a")
def r12(spark, d):
    return audit.size_diagnostic(_study(spark, d))


@query("m20_ratios", f"{MEAS}, c AS (SELECT symbol, bar // {D} AS d, arg_max(close, bar) AS close FROM bars GROUP BY 1, 2), rr AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY d)) AS r FROM c), v AS (SELECT symbol, stddev_samp(r) AS vol FROM rr GROUP BY 1) SELECT round(0.0055 / nullif((SELECT quantile_cont(abs(disp), 0.5) FROM fin), 0), 6) AS over_displacement, round(0.0055 / nullif((SELECT avg(vol) FROM v), 0), 6) AS over_volatility")
def m20r(spark, d):
    return audit.ratios(study.economic(src.bars(src.dense(spark, d))), _study(spark, d))


@query("f8_relabelled", f"{LOUT} SELECT symbol, t0 + {5 * M} AS e0, round(peak_disloc, 6) AS disp, round(doi, 6) AS doi, round(perm_6h, 6) AS p6h, round(coalesce((hit - t0) / {M}.0, 1440.0), 6)::double AS rec_min, hit IS NOT NULL AS rec_event, CASE klass WHEN 'deleverage' THEN 'contraction' WHEN 'churn' THEN 'limited' WHEN 'middle' THEN 'intermediate' ELSE klass END AS klass FROM lout")
def f8(spark, d):
    return audit.relabelled(_old(spark, d), P)


@query("j10_retained", f"{MEMBER}, lo2 AS (WITH {LOUT} SELECT symbol, t0, peak_disloc FROM lout) SELECT m.symbol, m.legacy_t0, m.status, m.corrected_class, round(l.peak_disloc, 6) AS peak_disloc FROM mem m JOIN lo2 l ON l.symbol = m.symbol AND l.t0 = m.legacy_t0 WHERE m.e0 IS NOT NULL")
def j10(spark, d):
    old = _old(spark, d).select("symbol", F.col("t0").alias("legacy_t0"), "peak_disloc")
    return _members(spark, d).where("e0 is not null").join(old, ["symbol", "legacy_t0"]).select("symbol", "legacy_t0", "status", "corrected_class", "peak_disloc")


@query("a7_transitions", f"{MEMBER} SELECT legacy_class, count(*) FILTER (corrected_class = 'contraction') AS contraction, count(*) FILTER (corrected_class = 'limited') AS \"limited\", count(*) FILTER (corrected_class = 'intermediate') AS intermediate, count(*) FILTER (corrected_class = 'unknown') AS \"unknown\", count(*) FILTER (corrected_class IS NULL) AS gone FROM mem WHERE legacy_class IS NOT NULL GROUP BY 1")
def a7t(spark, d):
    m = _members(spark, d).where("legacy_class is not null")
    return m.groupBy("legacy_class").agg(*[F.count_if(F.col("corrected_class") == k).alias(k) for k in ("contraction", "limited", "intermediate", "unknown")], F.count_if(F.col("corrected_class").isNull()).alias("gone"))


@query("e4_recovery_spearman", f"{LOUT}, l2 AS (SELECT symbol || ':' || t0 AS id, round(-doi, 9) AS x, coalesce((hit - t0) / {M}.0, 1440.0)::double AS y FROM lout WHERE doi IS NOT NULL), k AS (SELECT id, {RANKS} FROM l2), {dealt_sql('ry', 'rx', 199)}, dr AS (SELECT b, corr(rx, ry) AS d, count(*) AS n FROM sh GROUP BY b) {TWO_SIDED}")
def e4(spark, d):
    old = _old(spark, d).select(F.concat_ws(":", "symbol", "t0").alias("id"), F.round(-F.col("doi_event"), 9).alias("x"), "ttr_min")
    return stats.spearman_permutation(old, "x", "ttr_min", 199)


@query("e2_regression")
def e2(spark, d):
    return audit.size_regression(spark, study.clustered(_study(spark, d, calm=True)), 9999)


@query("r12_regression")
def r12r(spark, d):
    return audit.response_regression(spark, study.clustered(_study(spark, d, calm=True)), 9999)


@query("g7_curves", f"{calm(MEAS)}, rows_ AS (SELECT klass AS grp, rec_min AS d, rec_event AS ev FROM fin WHERE analysable AND klass IN ('contraction', 'limited')){KM[len(SURV):]}, gs AS (SELECT DISTINCT grp FROM rows_), pt AS (SELECT grp, 'step' AS mark, d, s, 0::bigint AS n_censored FROM km UNION ALL SELECT grp, 'start', 0.0, 1.0, 0 FROM gs UNION ALL SELECT grp, 'end', 1320.0, coalesce((SELECT min(s) FROM km WHERE km.grp = gs.grp), 1.0), 0 FROM gs UNION ALL SELECT grp, 'censored', d, coalesce((SELECT min(s) FROM km WHERE km.grp = r.grp AND km.d <= r.d), 1.0), count(*) FROM rows_ r WHERE NOT ev GROUP BY grp, d) SELECT grp AS klass, mark, round(d, 6)::double AS rec_min, round(s, 6) AS s, n_censored FROM pt")
def g7(spark, d):
    return audit.curves(_study(spark, d, calm=True))


from . import effect_queries, robustness_queries  # noqa: E402, F401  (they register their queries with the names above)

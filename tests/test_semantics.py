"""Edges that the driver tables lack: ties, ages, exact gaps, hand-checked survival."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import shuffles, stats
from tidemark.operators import clock, lookups, measures, quality
from tidemark.params import DAY, MINUTE, MONTH, Study


def test_asof_ties_take_the_last_stored_row_and_age_is_inclusive(spark):
    rows = spark.createDataFrame([("A", 0, 1.0, 1), ("A", 0, 2.0, 2)], "symbol string, t bigint, v double, ingest_idx bigint")
    probes = spark.createDataFrame([("A", 2 * MINUTE), ("A", 2 * MINUTE + 1), ("A", 3 * DAY), ("B", 0)], "symbol string, t bigint")
    got = {(r.symbol, r.t): r.v for r in lookups.asof(probes, rows, ["v"], 2).select("symbol", "t", "v").collect()}
    assert got == {("A", 2 * MINUTE): 2.0, ("A", 2 * MINUTE + 1): None, ("A", 3 * DAY): None, ("B", 0): None}
    got = {(r.symbol, r.t): r.v for r in lookups.asof(probes, rows, ["v"]).select("symbol", "t", "v").collect()}
    assert got["A", 3 * DAY] == 2.0


def test_quiet_gap_is_strict(spark):
    t = spark.createDataFrame([("A", 0), ("A", 120 * MINUTE), ("A", 240 * MINUTE + 1)], "symbol string, e bigint")
    assert [r.chain for r in clock.chained(t, Study()).orderBy("e").collect()] == [0, 0, 1]


def test_islands_cross_days(spark):
    t = spark.createDataFrame([("A", DAY - MINUTE), ("B", DAY + MINUTE), ("A", 3 * DAY)], "symbol string, e0 bigint")
    assert [r.episode for r in clock.islands(t, 405).orderBy("e0").collect()] == [0, 0, 1]


def test_survival_by_hand(spark):
    d = spark.createDataFrame([("g", x, e) for x, e in ((10.0, True), (20.0, True), (20.0, False), (30.0, True), (40.0, False))], "grp string, d double, ev boolean")
    km = stats.kaplan_meier(d)
    assert [round(r.s, 9) for r in km.orderBy("d").collect()] == [0.8, 0.6, 0.3]
    assert abs(stats.rmst(km, d.select("grp").distinct(), 35.0).first().rmst - 25.5) < 1e-9


def test_table_equality_counts_cells(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "z"), (2, None, "y"), (3, 0.0, "q")], "k int, v double, s string")
    r = quality.tables_equal(a, b, ["k"]).first()
    assert (r.only_a, r.only_b, r.cells) == (0, 1, 1)


def test_reinstated_rows(spark):
    f = spark.createDataFrame([(0, "A", 1), (3, "A", 2), (4, "A", 3)], "ingest_idx bigint, symbol string, t bigint").withColumn("side", F.lit("sell")).withColumn("notional", F.lit(1.0))
    assert quality.reinstated(f, quality.dropped(f)).count() == 5


def test_bootstrap_interval_ends_where_p_crosses(spark):
    # a slope of 0.009 that a fixed grid of nulls, a tenth apart, cannot bracket
    rows = spark.range(2000).selectExpr("id % 23 as cl", "id % 13 / 13.0D as x", "0.009D * (id % 13) / 13.0D + ((id * 7919) % 101 - 50) / 2000.0D + (id % 23 - 11) / 900.0D * (id % 13) / 13.0D as y")
    r = stats.wild_interval(spark, rows, "y", ["x"], "cl", 199).first()
    assert r.lo < r.coef < r.hi < r.coef + 6 * r.se and r.lo > r.coef - 6 * r.se
    near = [r.lo - 0.1 * r.se, r.lo + 0.1 * r.se, r.hi - 0.1 * r.se, r.hi + 0.1 * r.se, 0.0]
    p = {x.beta0: x.p for x in stats.wild_bootstrap(spark, rows, "y", ["x"], "cl", 199, nulls=tuple(near)).collect()}
    assert p[near[0]] <= 0.05 < p[near[1]] and p[near[3]] <= 0.05 < p[near[2]] and p[0.0] == r.p


def test_quantiles_are_exact_and_no_task_holds_a_group(spark):
    # ties, outliers of a wide range, one value that holds half of a group, a group of one
    rows = spark.range(4000).selectExpr("case when id = 7 then 'c' when id % 3 = 0 then 'a' else 'b' end as g", "id % 11 as cl", "case when id % 3 = 1 and id % 2 = 0 then 5.0D when id % 401 = 0 then 1e12D * id else (id * 7919) % 1009 / 7.0D end as v")
    draws = stats.cluster_draws(spark, rows, "cl", 5)
    for q in (0.0, 0.31, 0.5, 1.0):
        want = {r.g: r.m for r in rows.groupBy("g").agg(F.expr(f"percentile(v, {q}D)").alias("m")).collect()}
        assert {r.g: r.q for r in stats.quantile(rows, "v", "g", q).collect()} == want
    want = {(r.b, r.g): r.m for r in rows.join(draws, "cl").groupBy("b", "g").agg(F.expr("percentile(v, 0.5D, freq)").alias("m")).collect()}
    found = stats.quantile(rows, "v", "g", 0.5, "cl", draws)
    assert {(r.b, r.g): r.q for r in found.collect()} == want


def test_average_ranks_are_exact_and_keyless_windows_stay_small(spark):
    values = [None if i % 97 == 0 else float(i * 7919 % 701 if i % 3 else 4) for i in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    kept = sorted(v for v in values if v is not None)
    first, last = {v: i for i, v in reversed(list(enumerate(kept)))}, {v: i for i, v in enumerate(kept)}
    got = stats.average_ranks(rows, "v", "r")
    assert all(r.r == (first[r.v] + last[r.v]) / 2 + 1 for r in got.collect()) and got.count() == len(kept)


def test_settings_belong_to_one_step():
    from tidemark.params import Study

    p = Study().but(quiet_min=60, share=0.2, reference=(35, 10))
    assert (p.clock.quiet_min, p.classes.share, p.window.reference, Study().clock.quiet_min) == (60, 0.2, (35, 10), 120)
    for wrong in ({"nothing": 1}, {"label": "middle"}, {"rule": "none"}):
        with pytest.raises(ValueError):
            Study().but(**wrong)


def test_pairs_and_fallback_sides(spark):
    from tidemark.operators import quality

    rows = [("A", 1, "sell", "Close Long"), ("A", 1, "buy", "x"), ("A", 1, "buy", "x"), ("A", 1, "sell", "x"), ("B", 1, "none", "Close Long"), ("B", 2, None, "open long"), ("B", 2, "none", "short"), ("C", 1, "Ask", None)]
    d = spark.createDataFrame(rows, "symbol string, t bigint, side string, direction string")
    assert quality.equal_pairs(d, ["symbol", "t"]).first().n == 4 and quality.equal_pairs(d.limit(0), ["t"]).first().n == 0
    assert sorted((r.symbol, r.n) for r in quality.permissive_sells(d).groupBy("symbol").count().withColumnRenamed("count", "n").collect()) == [("A", 2), ("B", 2), ("C", 1)]


def test_archive_columns_by_any_name(spark):
    from tidemark.sources import context

    raw = spark.createDataFrame([("x", "5", "7", None, "9.5"), ("x", "bad", "7", "1", "2"), ("x", "6", "n/a", "1", "2")], "Coin string, time string, openInterest string, midPx string, MARK_PX string")
    assert [tuple(r) for r in context.asset_context(raw).collect()] == [("x", 5, 7.0, None, 9.5, None)]


def test_regression_report_by_hand(spark):
    import hashlib
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    n, draws = 120, 99
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n), rng.integers(0, 2, n)]).astype(float)
    cl = rng.integers(0, 12, n)
    y = 0.3 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) + rng.normal(size=12)[cl]
    d = spark.createDataFrame([(float(b), *map(float, a), int(g)) for a, b, g in zip(x, y, cl)] + [(None, 0.0, 0.0, 0.0, 1)], "y double, one double, size double, eth double, cl int")
    got = stats.regression_report(spark, d, "y", ["one", "size", "eth"], "cl", draws).first()
    full = np.column_stack([np.ones(n), x])
    inverse = np.linalg.inv(full.T @ full)
    groups = sorted(set(cl))
    spread = lambda u: np.array([(full[cl == g] @ inverse[1]) @ u[cl == g] for g in groups])
    beta = inverse @ full.T @ y
    s = spread(y - full @ beta)
    se = math.sqrt(len(groups) / (len(groups) - 1) * (n - 1) / (n - 4) * (s @ s))
    assert (got.n, got.g, got.df) == (n, len(groups), len(groups) - 1)
    assert abs(got.coef - beta[1]) < 1e-9 and abs(got.se_cr1 - se) < 1e-9
    part = full[:, [0, 2, 3]]
    fit = part @ np.linalg.lstsq(part, y, rcond=None)[0]
    six = [-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)]
    t0, hits = abs(beta[1]) / math.sqrt(s @ s), 0
    for b in range(1, draws + 1):
        v = np.array([six[int(hashlib.md5(f"7:{b}:{g}".encode()).hexdigest()[:8], 16) % 6] for g in cl])
        again = fit + v * (y - fit)
        bb = inverse @ full.T @ again
        sb = spread(again - full @ bb)
        hits += abs(bb[1]) / math.sqrt(sb @ sb) >= t0
    assert abs(got.p_wcr - hits / draws) < 1e-9
    assert got.lo_wcr < got.coef < got.hi_wcr and got.lo_cr1 < got.coef < got.hi_cr1
    same = d.withColumn("eth", F.col("one"))
    none = stats.regression_report(spark, same, "y", ["one", "size", "eth"], "cl", draws).first()
    assert none.coef is None and none.lo_wcr is None and none.n == n
    assert stats.regression_report(spark, d.limit(0), "y", ["one"], "cl", draws).first().n == 0


def test_student_tail_and_quantile(spark):
    tail, upper = stats.student(10)
    assert abs(tail(2.2281388519649385) - 0.05) < 1e-7 and abs(upper(0.05) - 2.2281388519649385) < 1e-6
    tail, upper = stats.student(1)
    assert abs(tail(1.0) - 0.5) < 1e-7


def test_shuffles_keep_the_values_and_draw_zero(spark):
    d = spark.createDataFrame([(i, float(i * i), i % 3) for i in range(40)], "id int, v double, w int")
    got = stats.shuffled(d, "v", 3, 3).collect()
    assert {(r.id, r.v) for r in got if r.b == 0} == {(i, float(i * i)) for i in range(40)}
    for b in (1, 2, 3):
        mine = [(r.id, r.v) for r in got if r.b == b]
        assert sorted(v for _, v in mine) == [float(i * i) for i in range(40)] and any(v != i * i for i, v in mine)
    few = stats.spearman_permutation(d.where("id < 14"), "v", "w", 9).first()
    assert (few.est, few.p, few.n) == (None, None, 14)
    none = stats.slope_permutation(d.where("id < 0"), "v", "w", "w", 9).first()
    assert (none.est, none.p, none.n) == (None, None, 0)
    line = stats.spearman_permutation(d, "v", "id", 19).first()
    assert abs(line.est - 1) < 1e-12 and abs(line.p - 1 / 20) < 1e-12


def test_a_rebuilt_table_that_differs_ends_the_job(spark):
    stored = spark.createDataFrame([("A", 1, 1.0, "x"), ("A", 2, None, "y"), ("B", 1, 3.0, None)], "s string, t int, v double, k string")
    assert quality.verified(stored.repartition(3), stored, ["s", "t"]).count() == 3
    assert quality.verified(stored.withColumn("v", F.col("v") + 1e-13), stored, ["s", "t"]).count() == 3
    cell = stored.withColumn("v", F.when(F.col("s") == "B", 3.0 + 1e-9).otherwise(F.col("v")))
    with pytest.raises(quality.Mismatch, match="1 cells of v differ, first at B:1"):
        quality.verified(cell, stored, ["s", "t"])
    with pytest.raises(quality.Mismatch, match="1 cells of k differ, first at A:2"):
        quality.verified(stored.withColumn("k", F.when(F.col("t") == 2, None).otherwise(F.col("k"))), stored, ["s", "t"])
    with pytest.raises(quality.Mismatch, match="1 rows only in the stored table, first B:1"):
        quality.verified(stored.where("s = 'A'"), stored, ["s", "t"])
    counts = stored.groupBy("s").agg(F.count("*").alias("n"))
    assert quality.expected(counts, ["s"], {("A",): {"n": 2}}).count() == 2
    with pytest.raises(quality.Mismatch, match="n of B is 1, not 2"):
        quality.expected(counts, ["s"], {("B",): {"n": 2}})


def test_bins_may_arrive_out_of_order(spark):
    from tidemark.params import MONTH
    from tidemark.storage import shared_dir
    from tidemark.streaming import clock as live

    hour = 60 * MINUTE
    rows = [(s, (i + 48) * hour, float((i * 7919 + len(s)) % 97) + (500.0 if i % 131 == 7 else 0.0)) for s in ("A", "BB") for i in range(20 * 24)]
    d = spark.createDataFrame(rows, "symbol string, e bigint, r double")
    part = F.floor((F.col("e") / hour + F.pmod(F.xxhash64("symbol", "e"), F.lit(10))) / 48)  # files overlap by some hours
    path = f"{shared_dir(spark)}/late-bins"
    for k in range(12):
        d.where(part == k).orderBy(F.xxhash64("e")).coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.drained(live.trailing_triggers(files, MONTH, "12 hours"))
    whole = live.drained(live.trailing_triggers(live.as_stream(d.coalesce(1).sortWithinPartitions("e")), MONTH))
    end = got.agg(F.max("e")).first()[0]
    assert end >= (20 * 24 - 14) * hour and got.where("trigger").count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in whole.collect() if r.e <= end)


def test_manifest_names_changed_and_missing_files(spark, tmp_path):
    import hashlib

    for name, data in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(data)
    want = [("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", hashlib.sha256(b"2").hexdigest()), ("d.bin", hashlib.sha256(b"four").hexdigest())]
    expected = spark.createDataFrame(want, "name string, sha256 string")
    assert sorted(r.name for r in quality.manifest(spark, str(tmp_path), expected).collect()) == ["b.bin", "d.bin"]
    assert quality.manifest(spark, str(tmp_path), expected.where("name = 'a.bin'")).count() == 0


def test_builds_delete_what_they_staged(spark):
    import os

    from tidemark.storage import shared_dir, staged, tidied

    folder = shared_dir(spark).removeprefix("file:")
    there = lambda: {x for x in os.listdir(folder) if x.startswith("staged-")}

    @tidied
    def inner(n):
        return staged(staged(spark.range(n)).withColumn("a", F.lit(1)))

    @tidied
    def outer(n):
        return inner(n).where("id > 2")

    @tidied
    def broken(n):
        staged(spark.range(n))
        raise ValueError("no")

    before = there()
    out = outer(9)
    with pytest.raises(ValueError):
        broken(3)
    assert out.count() == 6 and len(there() - before) == 1


def test_sizes_are_rounded_as_the_sql_rounds_them(spark):
    import duckdb

    values = [k / 100 / 100 for k in range(-3000, 30000)] + [0.285, 1.005, 2.675, -1.005, 0.125, 28.5 / 100]
    d = spark.createDataFrame([(v,) for v in values], "sz double")
    got = [r.z / 100 for r in d.select("sz", quality.scaled("sz", 2).alias("z")).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(v, 2) FROM (SELECT unnest(?::double[]) AS v)", [values]).fetchall()]
    assert got == want
    two = spark.createDataFrame([("sell", 28.5 / 100), ("buy", 0.28), ("buy", 0.29)], "side string, sz double").withColumn("z", quality.scaled("sz", 2))
    assert quality.equal_pairs(two, ["z"]).first().n == 1


def _place(seed, b, i):
    return int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16), i


@pytest.mark.parametrize("small", [False, True])
def test_shuffled_sums_match_plain_shuffles(spark, monkeypatch, small):
    if small:  # many blocks, chunks, stretches; windows that miss
        for name, size in (("LANES", 64), ("CHUNK", 300), ("BLOCK", 128), ("STRETCH", 50), ("WORK", 1000), ("REACH", 0)):
            monkeypatch.setattr(shuffles, name, size)
    rows = [(i * 7 - 50, float((i * 7919) % 1013), float(i % 13), (i * i) % 31 / 7.0) for i in range(2000)]
    d = spark.createDataFrame(rows, "id bigint, x double, y double, z double").repartition(5)
    dealt = {r.b: (r.y, r.z) for r in shuffles.dealt_sums(d, "x", ["y", "z"], 2000, 4, 3).collect()}
    named = {r.b: (r.y, r.z) for r in shuffles.labelled_sums(d.drop("x"), ["y", "z"], 700, 2000, 4, 3).collect()}
    assert set(dealt) == set(range(5)) and set(named) == {1, 2, 3, 4}
    own = sorted(rows, key=lambda r: _place(3, 0, r[0]))
    for b in range(5):
        mine = sorted(rows, key=lambda r: _place(3, b, r[0]))
        for k in (0, 1):
            assert dealt[b][k] == pytest.approx(sum(p[1] * q[k + 2] for p, q in zip(own, mine)), rel=1e-12)
            assert b == 0 or named[b][k] == pytest.approx(sum(r[k + 2] for r in mine[:700]), rel=1e-12)


def test_labels_are_whole_where_the_window_misses(spark):
    # one id for all rows: every digest of a draw is the same, so no window by share holds the last label
    d = spark.createDataFrame([(5, 1.0)] * 5000, "id bigint, v double")
    assert [r.v for r in shuffles.labelled_sums(d, ["v"], 1700, 5000, 3, 3).collect()] == [1700.0] * 3
    assert [r.v for r in shuffles.dealt_sums(d.withColumn("x", F.lit(2.0)), "x", ["v"], 5000, 2, 3).collect()] == [10000.0] * 3


def test_digests_of_whole_columns_are_md5(spark):
    import pyarrow as pa

    ids = [f":{i}" for i in (0, 5, 12, -7, 123456789, 10**18, "x" * 60, "é")] + [""]
    found = shuffles.Messages(pa.array(ids))
    for prefix in (b"3:1", b"3:17", b"11:123"):
        assert found.digests(prefix).tolist() == [int(hashlib.md5(prefix + i.encode()).hexdigest()[:8], 16) for i in ids]


def test_permutations_do_not_multiply_rows_by_draws(spark, monkeypatch):
    # before, each made a row of every row and draw by an explode
    def never(*_, **__):
        raise AssertionError("rows met draws")

    for name in ("placed", "relabelled", "shuffled"):
        monkeypatch.setattr(stats, name, never)
    d = spark.range(60).selectExpr("id", "cast((id * 37) % 11 as double) as v", "cast((id * 17) % 7 as double) as w", "id % 3 = 0 as one")
    found = [stats.permutation(spark, d, "v", "one", 9), stats.ols_permutation(d, "v", "one", "w", 9), stats.slope_permutation(d, "v", "w", "id", 9), stats.slopes_permutation(d, "v", "w", ["id"], 9), stats.spearman_permutation(d, "v", "w", 9)]
    found = [x.first() for x in found]
    assert all(x.est is not None and 0.1 <= x.p <= 1 for x in found)
    assert found[2].est == pytest.approx(found[3].est) and found[2].p == found[3].p
    flat = d.withColumn("w", F.lit(2.0))
    assert (stats.slope_permutation(flat, "v", "w", "id", 9).first().est, stats.slopes_permutation(flat, "v", "w", ["id"], 9).first().est) == (None, None)


def test_a_pattern_that_returns_has_one_response_and_one_class(spark):
    r = random.Random(5)
    interest = [1000 + 0.02 * r.uniform(0, 500) for _ in range(40)]
    interest[20] = 900.0
    onsets = [(s, 20_000 * DAY + i * 31 * DAY) for i in range(40) for s in ("BTC", "ETH")]
    rows = [(s, e0 + (5 * k - 75) * MINUTE, v) for s, e0 in onsets for k, v in enumerate(interest)]
    r.shuffle(rows)
    ev = measures.windowed(spark.createDataFrame(onsets, "symbol string, e0 bigint"), MONTH)
    snaps = spark.createDataFrame(rows, "symbol string, t bigint, oi double").repartition(7)
    # small tables would else be joined into one partition, whose rows happen to be in order
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = measures.classify(measures.from_interest(ev, snaps, MONTH, ("symbol", "e0")), MONTH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    total = 0.0
    for v in interest[:13]:
        total += v
    assert len(found) == 80 and {x.doi for x in found} == {(900.0 - total / 13) / (total / 13)}
    assert {x.klass for x in found} == {"contraction"}


def test_ordered_means_skip_nulls(spark):
    d = spark.createDataFrame([("a", 3, 0.3), ("a", 1, 0.1), ("a", 2, 0.2), ("a", 4, None), ("b", 1, None)], "k string, i int, v double")
    got = {x.k: x.m for x in d.groupBy("k").agg(measures.ordered_mean("v", "i").alias("m")).collect()}
    assert got == {"a": (0.1 + 0.2 + 0.3) / 3, "b": None}

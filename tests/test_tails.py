"""Tail probabilities against closed forms and numerical integration."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import stats, tails


def test_chi_square_tail_keeps_small_values(spark):
    xs = [0.0, 1e-12, 0.3, 1.0, 3.84, 7.999, 8.0, 8.001, 20.0, 90.0, 400.0, 1400.0]
    got = {r.x: r.p for r in spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select("x", tails.chi_square_tail(F.col("x")).alias("p")).collect()}
    assert got.pop(None) is None
    for x, p in got.items():
        assert math.isclose(p, math.erfc(math.sqrt(x / 2)), rel_tol=1e-12)


def test_student_tail_of_odd_and_even_degrees(spark):
    closed = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))}
    rows = [(t, df) for t in (0.0, 0.4, -2.5, 11.0) for df in (1, 2, 3, 4, 9, 30, 401)]
    frame = spark.createDataFrame([*rows, (1.0, 0), (None, 3), (1.0, None)], "t double, df bigint")
    got = {(r.t, r.df): r.p for r in frame.select("t", "df", tails.student_tail(F.col("t"), F.col("df")).alias("p")).collect()}
    assert [got.pop(k) for k in ((1.0, 0), (None, 3), (1.0, None))] == [None] * 3
    for (t, df), p in got.items():
        assert abs(p - stats.student(df)[0](t)) < 1e-6
        assert df not in closed or math.isclose(p, closed[df](abs(t)), rel_tol=1e-9, abs_tol=1e-15)


def test_log_rank_reports_its_tail(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(r.exponential(s)), bool(r.random() < 0.8), i % 9) for g, s in (("a", 1.0), ("b", 1.8)) for i in range(60)]
    d = spark.createDataFrame(rows, "grp string, d double, ev boolean, cl int")
    for found in (stats.log_rank(d, "a"), stats.robust_log_rank(d, "a", "cl")):
        one = found.first()
        assert 0 < one.p < 1 and math.isclose(one.p, math.erfc(math.sqrt(one.chi2 / 2)), rel_tol=1e-12)
    none = stats.log_rank(d.where("grp = 'a'"), "a").first()
    assert none.chi2 is None and none.p is None

"""Effects, grids and permutation tests against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import linear, permutation, stats
from tidemark.plans import audit, effects, grid


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_places_follow_the_law_of_shuffles():
    rng = np.random.default_rng(0)
    for n, n1 in ((7, 3), (10, 4), (12, 6), (31, 11)):
        got = permutation.middle_places(rng, n, n1, 60_000)
        want = np.empty((20_000, 4))
        for i in range(len(want)):
            one = np.sort(rng.permutation(n)[:n1])
            rest = np.setdiff1d(np.arange(n), one)
            want[i] = one[(n1 - 1) // 2], one[n1 // 2], rest[(n - n1 - 1) // 2], rest[(n - n1) // 2]
        assert np.abs(got.mean(0) - want.mean(0)).max() < 0.1 and np.abs(np.corrcoef(got.T) - np.corrcoef(want.T)).max() < 0.03
        assert (got[:, 0] <= got[:, 1]).all() and (got[:, 2] <= got[:, 3]).all() and not (got[:, :1] == got[:, 2:3]).any()


def test_median_and_rate_tests(spark):
    r = random.Random(2)
    rows = [("a", i % 3 == 0, r.choice([1.0, 2.0, 2.5, 7.0]) + (i % 3 == 0) * 0.8, r.random() < 0.3) for i in range(41)]
    rows += [("b", i < 4, float(i * i % 7), i % 2 == 0) for i in range(9)] + [("c", i < 2, float(i), True) for i in range(9)] + [("a", True, None, None), ("a", None, 3.0, True)]
    d = spark.createDataFrame(rows, "k string, one boolean, v double, yes boolean")
    got = {x.k: x for x in permutation.median_tests(d, ["k"], "v", "one", 4000).collect()}
    again = {x.k: x.p for x in permutation.median_tests(d.repartition(7), ["k"], "v", "one", 4000).collect()}
    rates = {x.k: x for x in permutation.rate_tests(d, ["k"], "yes", "one", 4000).collect()}
    rng = np.random.default_rng(1)
    for k in "ab":
        one = np.array([x[2] for x in rows if x[0] == k and x[1] and x[2] is not None])
        rest = np.array([x[2] for x in rows if x[0] == k and x[1] is False])
        est, pool, hits = np.median(one) - np.median(rest), np.concatenate([one, rest]), 0
        for _ in range(4000):
            s = rng.permutation(pool)
            hits += abs(np.median(s[: len(one)]) - np.median(s[len(one) :])) >= abs(est) - 1e-12
        assert (got[k].n1, got[k].n2) == (len(one), len(rest)) and abs(got[k].est - est) < 1e-12
        assert abs(got[k].p - (hits + 1) / 4001) < 0.035 and again[k] == got[k].p
        y1 = [x[3] for x in rows if x[0] == k and x[1] and x[3] is not None]
        y2 = [x[3] for x in rows if x[0] == k and x[1] is False]
        share, total, n = np.mean(y1) - np.mean(y2), sum(y1) + sum(y2), len(y1) + len(y2)
        law = {h: math.comb(total, h) * math.comb(n - total, len(y1) - h) / math.comb(n, len(y1)) for h in range(max(0, len(y1) - n + total), min(total, len(y1)) + 1)}
        exact = sum(q for h, q in law.items() if abs(h / len(y1) - (total - h) / len(y2)) >= abs(share) - 1e-12)
        assert abs(rates[k].est - share) < 1e-12 and abs(rates[k].p - exact) < 0.035
    assert got["c"].est is None and got["c"].p is None and rates["c"].est is None
    none = permutation.median_tests(d.limit(0), ["k"], "v", "one", 10)
    assert none.count() == 0 and permutation.median_tests(d, ["k"], "v", "one", 0).where("p is not null").count() == 0


def test_least_squares_in_columns(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("full", "one", "same"):
        x = rng.normal(size=(50, 3))
        x[:, 2] = 0.0 if k == "one" else 2 * x[:, 0] if k == "same" else x[:, 2]
        rows += [(k, *map(float, r), float(r @ [1.0, -2.0, 0.5] + 3 + rng.normal())) for r in x]
    got = {r.k: r for r in linear.regressions(spark.createDataFrame(rows, "k string, a double, b double, c double, y double"), ["k"], "y", ["a", "b", "c"]).collect()}
    for k, used in (("full", [0, 1, 2]), ("one", [0, 1])):
        x = np.array([[1.0, *r[1:4]] for r in rows if r[0] == k])[:, [0, *[i + 1 for i in used]]]
        y = np.array([r[4] for r in rows if r[0] == k])
        want, inverse = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.inv(x.T @ x)
        assert np.allclose([got[k][f"b{i}"] for i in range(len(used) + 1)], want) and np.allclose(got[k].v1_1, inverse[1, 1]) and np.allclose(got[k].rss, ((y - x @ want) ** 2).sum())
    assert got["one"].b3 == 0 and got["same"].b3 is None


def test_numbers_are_dense_and_multiplicities_add_up(spark):
    d = spark.createDataFrame([(k, f"c{i % n:03d}") for k, n in (("x", 17), ("y", 3)) for i in range(60)], "k string, cl string")
    numbers = {(r.k, r.cl): r.number for r in stats.numbered(d, ["k"], "cl").collect()}
    assert numbers == {(k, f"c{i:03d}"): i for k, n in (("x", 17), ("y", 3)) for i in range(n)}
    drawn = stats.multiplicities(d, ["k"], "cl", 20, 5).collect()
    for k, n in (("x", 17), ("y", 3)):
        for b in range(1, 21):
            want = [0] * n
            for slot in range(n):
                want[digest(5, b, slot) % n] += 1
            assert {r.cl: r.freq for r in drawn if r.k == k and r.b == b} == {f"c{i:03d}": w for i, w in enumerate(want) if w}


EVENTS = "spec string, symbol string, klass string, analysable boolean, short string, long string, tau double, sized boolean, continuous boolean, disp double, doi double, p6h double, p24h double, reversion double, intensity double, rec_min double, rec_event boolean"


def market(seed, n=70):
    r = np.random.default_rng(seed)
    base = []
    for i in range(n):
        one = i % 2 == 0
        value = lambda shift, i=i, one=one: None if (i + shift) % 19 == 0 else float(r.normal() - 0.4 * one + 0.3 * math.sin(i // 4))
        base.append(("BTC" if i % 3 else "ETH", "contraction" if one else "limited" if i % 7 else "intermediate", i % 11 != 0, f"s{i // 4:02d}", f"l{i // 9}", value(0), -abs(value(1) or 0.1), value(2), value(3), value(4), float(math.exp(r.normal())), float(r.integers(1, 60)), bool(r.random() < 0.7)))
    settings = (("all", lambda e: True, True, False), ("btc", lambda e: e[0] == "BTC", True, False), ("plain", lambda e: True, False, False), ("wide", lambda e: True, True, True))
    out = [(name, e[0], e[1], e[2], e[3], e[4], 40.0, sized, wide, *e[5:]) for name, keep, sized, wide in settings for e in base if keep(e)]
    return out + [("few", *x[1:]) for x in out[:5]]


def median(values):
    return float(np.median(values))


def rmst(rows, tau):
    s, area, last = 1.0, 0.0, 0.0
    for t in sorted({d for d, e in rows if e}):
        if t >= tau:
            break
        area += s * (t - last)
        s *= 1 - sum(d == t and e for d, e in rows) / sum(d >= t for d, e in rows)
        last = t
    return area + s * (tau - last)


def test_effects_of_many_settings(spark):
    draws, rows = 49, market(4)
    d = spark.createDataFrame(rows, EVENTS)
    got = {(r.spec, r.effect): r for r in effects.effects(d, draws, draws, seed=11).collect()}
    names = [c.split()[0] for c in EVENTS.split(", ")]
    for spec in ("all", "btc", "plain", "wide"):
        mine = [dict(zip(names, x)) for x in rows if x[0] == spec]
        c = [x for x in mine if x["analysable"] and x["klass"] in ("contraction", "limited")]
        for effect, column, factor, far in effects.MEDIANS:
            used = [(x["klass"] == "contraction", x["long" if far else "short"], factor * x[column]) for x in c if x[column] is not None]
            clusters = sorted({x[1] for x in used})
            diff = lambda sample: median([v for o, _, v in sample if o]) - median([v for o, _, v in sample if not o])
            reps = []
            for b in range(1, draws + 1):
                picked = [clusters[digest(11, b, s) % len(clusters)] for s in range(len(clusters))]
                sample = [x for g in picked for x in used if x[1] == g]
                if len({o for o, _, _ in sample}) == 2:
                    reps.append(diff(sample))
            r = got[spec, effect]
            assert (r.n1, r.n2, r.clusters, r.used) == (sum(o for o, _, _ in used), sum(not o for o, _, _ in used), len(clusters), len(reps))
            assert np.allclose([r.est, r.lo, r.hi], [diff(used), *np.percentile(reps, [2.5, 97.5])])
        used = [(x["klass"] == "contraction", x["long"], x["rec_min"], x["rec_event"]) for x in c]
        clusters = sorted({x[1] for x in used})
        diff = lambda sample: rmst([x[2:] for x in sample if x[0]], 40) - rmst([x[2:] for x in sample if not x[0]], 40)
        reps = []
        for b in range(1, draws + 1):
            sample = [x for s in range(len(clusters)) for x in used if x[1] == clusters[digest(11, b, s) % len(clusters)]]
            if len({x[0] for x in sample}) == 2:
                reps.append(diff(sample))
        r = got[spec, "E6"]
        assert np.allclose([r.est, r.lo, r.hi], [diff(used), *np.percentile(reps, [2.5, 97.5])]) and r.p > 0
    assert all(got["few", e].est is None and got["few", e].lo is None for e in ("E1", "E2", "E6") if ("few", e) in got)


def test_one_cluster_keeps_the_coefficient_without_an_error(spark):
    d = spark.createDataFrame(market(4), EVENTS).where("spec <> 'few'")
    both = d.withColumn("spec", F.concat("spec", F.lit("/one"))).withColumn("short", F.lit("all")).unionByName(d)
    got = {r.spec: r for r in effects.effects(both, 0, 9, seed=3).where("effect = 'E2'").collect()}
    names = [k for k in got if not k.endswith("/one")]
    assert names and any(got[k].est is not None for k in names)
    for k in names:
        one = got[f"{k}/one"]
        assert (one.est is None) == (got[k].est is None) and (one.est is None or abs(one.est - got[k].est) < 1e-9)
        assert one.clusters == 1 and one.p_cr1 is None and one.p is None and one.lo is None and one.hi is None


def test_regressions_of_many_settings_equal_single_ones(spark):
    draws, d = 99, spark.createDataFrame(market(6), EVENTS)
    got = {r.spec: r for r in effects.regression_effect(d, draws, seed=7).collect()}
    rows = effects.regression_rows(d)
    for spec, xs in (("all", ["x", "size", "eth"]), ("btc", ["x", "size"]), ("plain", ["x", "eth"]), ("wide", ["x", "size", "eth"])):
        want = stats.regression_report(spark, rows.where(F.col("spec") == spec), "y", xs, "cluster", draws, seed=7).first()
        r = got[spec]
        assert np.allclose([r.est, r.se, r.g_eff, r.p], [want.coef, want.se_cr1, want.g_eff, want.p_wcr]) and r.clusters == want.g
        assert np.allclose([r.lo, r.hi], [want.lo_wcr, want.hi_wcr], rtol=0.02, atol=0.05 * r.se)
        assert abs(r.p_cr1 - want.p_cr1) < 1e-6


def test_verdicts_ask_for_sign_and_interval(spark):
    d = spark.createDataFrame([("p", "E1", -1.0, -2.0, -0.5), ("p", "E2", 1.0, -0.1, 2.0), ("p", "E3", 0.5, 0.1, 1.0), ("p", "E4", None, None, None), ("p", "E6", 3.0, 1.0, 5.0)], "spec string, effect string, est double, lo double, hi double")
    got = {r.effect: r.verdict for r in effects.verdicts(d, {"E1": -1, "E2": 1, "E3": -1, "E4": -1, "E6": 1}).collect()}
    assert got == {"E1": "Supported (exploratory)", "E2": "Directionally consistent, imprecise", "E3": "Not supported (opposite sign)", "E4": "n/a", "E6": "Supported (exploratory)"}


def test_regressors_follow_the_data(spark):
    r = np.random.default_rng(8)
    rows = [("BTC" if i % 2 else s, "contraction" if i % 3 else "limited", True, float(r.normal()), float(math.exp(r.normal())), i // 4) for s in ("BTC",) for i in range(60)]
    ev = spark.createDataFrame(rows, "symbol string, klass string, analysable boolean, disp double, intensity double, ep6 int")
    one = audit.size_regression(spark, ev, 49).first()
    assert one.coef is not None and one.n == 60
    bare = audit.size_regression(spark, ev.withColumn("intensity", F.lit(None).cast("double")), 49).first()
    assert bare.coef is not None and bare.n == 60


def test_settings_of_the_grid(spark):
    from tidemark.params import MONTH

    specs = grid.declared(MONTH, (0, 1), 3)
    assert len(specs) == len({s.name for s in specs}) == 19
    tau = {s.name: s.tau for s in specs}
    assert (tau["Primary"], tau["S13c"], tau["S13d"], tau["S6a"]) == (1320.0, 1380.0, 1260.0, 1440.0)
    assert len({s.clock for s in specs}) == 7 and len({s.build for s in specs}) == 11

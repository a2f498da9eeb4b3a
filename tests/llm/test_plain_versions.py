"""Language evidence and the mix against plain recomputations."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing
from tidemark.llm.common import staged

LANGS = ["de", "en", "fr"]
NAMES = [*LANGS, langid.NOISE]


def evidence(seed, n=160):
    r = random.Random(seed)
    hosts = [None, "a.com", "b.com", "c.b.com", "d.de", "www.d.de", "localhost", "10.0.0.1"]
    rows = []
    for i in range(n):
        ll = [r.uniform(-6, 0) for _ in NAMES]
        rows.append((i, ll, r.choice(NAMES), r.choice([None, "de", "en", "en", "xx", "12"]), r.choice(hosts), r.choice([0, 40, 90]), r.choice([0, 30, 30]), "en"))
    return rows


def plain_fuse(rows, weight):
    onehot = {i: np.array([float(r[2] == x) for x in NAMES]) for i, r in enumerate(rows)}
    everywhere = sum(onehot.values()) + 1
    top = everywhere / everywhere.sum()
    domain_of = lambda h: (re.search(r"([^.]+\.[^.]+)$", h) or [h])[0]
    suffix_of = lambda h: None if h is None or not re.search(r"\.([a-z]{2,})$", h) else re.search(r"\.([a-z]{2,})$", h)[1]
    host, domain = defaultdict(lambda: np.zeros(len(NAMES))), defaultdict(lambda: np.zeros(len(NAMES)))
    for i, r in enumerate(rows):
        if r[4] is not None:
            host[r[4]] = host[r[4]] + onehot[i]
            domain[domain_of(r[4])] = domain[domain_of(r[4])] + onehot[i]
    smooth = lambda v, p: (v + weight * p) / (v.sum() + weight)

    def given(values):
        counts = defaultdict(lambda: np.zeros(len(NAMES)))
        for i, v in enumerate(values):
            if v is not None:
                counts[v] = counts[v] + onehot[i]
        whole = sum(counts.values())
        return [np.zeros(len(NAMES)) if v is None else np.log((counts[v] + 1) / (whole + len(counts) + 1)) for v in values]

    declared, suffix = given([r[3] for r in rows]), given([suffix_of(r[4]) for r in rows])
    out = {}
    for i, r in enumerate(rows):
        prior = top
        if r[4] is not None:
            prior = smooth(np.maximum(host[r[4]] - onehot[i], 0), smooth(np.maximum(domain[domain_of(r[4])] - onehot[i], 0), top))
        logs = np.log(prior) + (np.array(r[1]) if r[5] > 0 else 0) + declared[i] + suffix[i]
        if r[3] is not None and re.search(r"^[a-z]{2,3}([-_]|$)", r[3]):
            logs[-1] = -1e9
        best = int(np.argmax(logs[:-1]))
        posterior = math.exp(logs[best] - logs.max()) / np.exp(logs - logs.max()).sum()
        out[r[0]] = (LANGS[best], posterior, r[5] == 0 or r[6] == 0 or logs[-1] > logs[best])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_language_evidence_is_fused_as_plainly(spark, seed):
    rows = evidence(seed)
    d = spark.createDataFrame(rows, "id bigint, ll array<double>, text_class string, declared string, host string, n_bytes bigint, letters bigint, text_lang string").withColumn("rare_lang", F.lit(None).cast("string"))
    got = {r.doc_id: (r.lang_pred, r.posterior, r.rejected) for r in langid.fuse(staged(d), LANGS, "doc_id", [], 4.0).collect()}
    want = plain_fuse(rows, 4.0)
    assert got.keys() == want.keys()
    for i, (lang, posterior, rejected) in want.items():
        assert got[i][0] == lang and got[i][2] == rejected and abs(got[i][1] - posterior) < 1e-9


def test_mix_takes_the_first_of_the_order_and_closes_the_gap(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice((0, 1, 5, 30, 200)), r.choice(["a", "b", "c", None])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("k", F.struct(F.lit(0).cast("bigint").alias("f"), F.col("doc_id").alias("i")))
    figures = {x.id: x for x in d.select(*mixing._figures(d, "doc_id", "text", "source", 42, "k")).collect()}
    got = {x.doc_id: x for x in mixing.pareto_mix(staged(d.drop("k"))).collect()}
    by = defaultdict(list)
    for i, x in got.items():
        by[figures[i].source].append((i, x))
    for docs in by.values():
        target, size = docs[0][1].target, docs[0][1].source_size
        certain = math.floor(min(target / size, 2.0) + 1e-12)
        lack = math.floor(max(target - certain * size, 0.0) + 0.5)
        order = []
        for i, x in docs:
            if x.size and x.inclusion is not None:
                u, odds = figures[i].u, x.inclusion / (1 - x.inclusion)
                order.append((u / (1 - u) / odds, i, x.size))
        order.sort()
        taken, done = set(), 0
        for _, i, n in order:
            if done + n > lack:
                break
            taken.add(i)
            done += n
        gap = lack - done
        rest = [(abs(gap - n), v, i) for v, i, n in order if i not in taken and n < 2 * gap]
        if rest:
            taken.add(min(rest)[2])
        assert Counter({i: x.copies for i, x in docs}) == Counter({i: (certain + (i in taken)) if x.size else 0 for i, x in docs})


def test_hot_keys_meet_their_rows_without_a_shuffle_of_them(spark):
    from tidemark.llm.common import HOT, having, staged

    rows = [(7, i) for i in range(3000)] + [(100 + i // 2, i) for i in range(5000)] + [(-1 - i, i) for i in range(40)] + [(None, 0)]
    d = spark.createDataFrame(rows, "key bigint, v bigint")
    n = d.where("key is not null").groupBy("key").count().where("count > 1").withColumnRenamed("count", "n")
    marks = staged(n)
    want = sorted((k, v) for k, v in rows if k is not None and k > 0)
    met = having(d, marks, ["key"], "n")
    assert sorted((r.key, r.v) for r in met.collect()) == want and met.columns == ["key", "v", "n"]
    assert marks.where(f"n * {HOT} > 8000").count() == 1
    assert having(d, staged(n.where("false")), ["key"], "n").count() == 0 and having(d.where("false"), marks, ["key"], "n").count() == 0

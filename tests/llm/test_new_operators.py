"""Divergence of sources, importance resampling and cover trees against plain versions, with nulls, ties, repeats, empty
tables, long texts and further columns."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import covertree, divergence, resample

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, `a.b` string, term string, s string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(seed, n=120):
    r = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "delta", "über", "eta", "ÀB", "x9y", "it's"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8)]
    rows = [(i, " ".join(r.choice(words[: r.choice((9, 49))]) for _ in range(r.choice((0, 3, 40)))), r.choice(["en", "de", "en", None]), r.choice(["s1", "s2", "s3", "é", "", None]), 1, "x", "t", "s") for i in range(n)]
    rows += [rows[3], rows[3], (n, None, "en", "quiet", 1, "x", "t", "s"), (None, "beta " * 30_000, "fr", "s1", 1, "x", "t", "s"), (n + 1, "", "fr", "s2", 1, "x", "t", "s"), (n + 2, "rare words", "xx", "s1", 1, "x", "t", "s"), (n + 3, None, "xx", "s2", 1, "x", "t", "s")]
    return rows


def plain_divergence(rows, least, top=10):
    docs = [(x[2] or "", x[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x[1]))) for x in rows]
    df, counts, group_of = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        group_of[lang].add(source)
    out = []
    for lang, sources in group_of.items():
        kept = [t for t, d in df[lang].items() if d >= least]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 2048), (2, 7)])
def test_divergence(spark, blocks):
    rows = documents(1)
    d = spark.createDataFrame(rows, SCHEMA)
    got = divergence.source_divergence(d, least_docs=4, group_block=blocks[0], term_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 4)
    assert divergence.source_divergence(d.limit(0)).count() == 0


def test_divergence_hands_on_when_full(spark, monkeypatch):
    rows = documents(2, 60)
    monkeypatch.setattr(divergence, "HELD", 5)
    got = divergence.term_counts(spark.createDataFrame(rows, SCHEMA)).where("term is not null").agg({"n": "sum", "d": "sum"}).first()
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x[1])) for x in rows]
    assert sorted(got) == sorted((sum(map(len, words)), sum(len(set(w)) for w in words)))


def plain_resample(rows, target, runs, least, percent, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)], len(w)

    k = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(k(f) for x in texts for f in features(x)[0]) for texts in ([x[1] for x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out, keys = [], []
    for i, x in enumerate(rows):
        f, words = features(x[1])
        total = sum(math.floor(1000 * math.log((t[k(y)] + 1) * (s_all + buckets) / ((s[k(y)] + 1) * (t_all + buckets)))) for y in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((x[0], len(f), weight, score))
        if words >= least:
            keys.append((-score, math.inf if x[0] is None else x[0], i))
    rank = {i: n + 1 for n, (_, _, i) in enumerate(sorted(keys)[: percent * len(keys) // 100])}
    return Counter((*x, rank.get(i)) for i, x in enumerate(out))


@pytest.mark.parametrize("runs", [1, 3])
def test_resample(spark, runs):
    rows = documents(3)
    target = ["alpha beta über wbc", None, "", "BETA beta x9y"]
    d, t = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.importance_resample(d, t, runs=runs, least_words=3, percent=30)
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, target, runs, 3, 30)
    none = resample.importance_resample(d, t.limit(0), least_words=10**9)
    assert Counter(map(tuple, none.collect())) == plain_resample(rows, [], 1, 10**9, 10)
    assert resample.importance_resample(d.limit(0), t).count() == 0


def test_selection_discards_down_to_the_exact_key(spark):
    keys = resample.staged(spark.range(20_000).selectExpr("pmod(hash(id), 50) as a", "id % 3 as b", "id as c").selectExpr("cast(a as bigint) a", "b", "c"))
    order = sorted(map(tuple, keys.collect()))
    for k in (1, 2, 777, 10_000, 19_999, 20_000):
        assert resample.smallest_key(keys, k, chunk=700, finish=16) == order[k - 1]
    rank = {(r.a, r.b, r.c): r["rank"] for r in resample.ranked(keys, ["a", "b", "c"]).collect()}
    assert [rank[x] for x in order] == list(range(1, 20_001))


def vectors(seed, dims=6):
    r = np.random.default_rng(seed)
    out = []
    for label in (0, 1, None):
        centers = r.normal(size=(6, dims))
        for c in centers:
            spread = r.choice([0.02, 0.2, 0.5])
            out += [(label, (c + spread * r.normal(size=dims)).tolist()) for _ in range(40)]
        out += [(label, (c * k).tolist()) for c in centers[:2] for k in (1.0, 1.0, 2.0, 3.0, 1e200, 1e-200)]
        out += [(label, v) for v in (None, [], [0.0] * dims, [None] * dims, [float("nan")] * dims, [float("inf")] * dims, [1.0, 2.0], [2.0, 4.0])]
    rows = [(i * 3 - 50, v, label, "clash") for i, (label, v) in enumerate(out)]
    return rows + [(None, rows[0][1], 0, "clash"), rows[5], rows[5]]


def plain_links(rows, cosine):
    ok = [i for i, (key, v, label, _) in enumerate(rows) if key is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    n, root = Counter(), {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i in ok:
        root[find(first.setdefault(rows[i][0], i))] = find(i)  # an id is one node
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / math.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), math.inf), rows[i][0])
    of = lambda i: least[find(i)] if i in unit else rows[i][0]
    return Counter((rows[i][0], n[i], of(i), rows[i][0] is not None and of(i) == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize(("cosine", "cell"), [(0.93, 2048), (0.93, 16), (0.6, 16), (0.999, 30)])
def test_near_vectors(spark, cosine, cell):
    rows = vectors(4)
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node string")
    got = Counter(map(tuple, covertree.near_vectors(d, cosine, cell=cell).collect()))
    assert got == plain_links(rows, cosine)


@pytest.mark.parametrize("broadcast", [4 << 20, 0])
def test_near_vectors_in_many_groups_of_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(covertree, "BROADCAST_BYTES", broadcast)  # of vectors that occur twice
    r = np.random.default_rng(8)
    far = [(int(label), v) for label, v in zip(r.integers(0, 2, 300), r.normal(size=(300, 24)).tolist())]
    near = [(label, (np.array(v) + 0.1 * r.normal(size=24)).astype(np.float32).tolist()) for label, v in far[:60] for _ in range(3)]
    zeros = [(0, [0.0, 1.0]), (0, [-0.0, 1.0]), (0, [1e-60, 1.0])]
    rows = [(i, v, label, "") for i, (label, v) in enumerate(far + near + zeros + near[:9] + 300 * near[:1])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node string")
    got = Counter(map(tuple, covertree.near_vectors(d, cell=16, group=4000).collect()))
    assert got == plain_links(rows, 0.93)


def test_each_pair_of_blocks_has_one_task_and_groups_are_bounded(spark):
    nodes = [f"{root}:8/{i}/{j}" for root in ("30", "31") for i in range(12) for j in range(3)]
    blocks = spark.createDataFrame([(n, [0.0] * (8 if n < "31" else 128), list(range(1 + i % 5))) for i, n in enumerate(nodes)], "node string, center array<double>, c array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes if a <= b and a[:2] == b[:2]], "i string, j string")
    tasks = covertree._tasks(blocks, pairs, 1200).collect()
    assert sorted((t.i, t.j) for t in tasks) == sorted(map(tuple, pairs.collect()))
    assert all(t.p <= t.q and t.p[:2] == t.i[:2] for t in tasks)
    of = {t.i: t.p for t in tasks if t.i == t.j}
    assert all({t.p, t.q} == {of[t.i], of[t.j]} for t in tasks)
    size = Counter()
    for i, n in enumerate(nodes):
        size[of[n]] += (64 if n < "31" else 128) * (1 + i % 5)
    assert max(size.values()) <= 1200 + 5 * 128
    sent = {(t.p, t.q, node) for t in tasks for node in (t.i, t.j)}
    assert len(sent) * 4 < 2 * pairs.count()  # one by one, each pair would send two blocks


def blocks_of(x, sizes):
    x = covertree.scaled(x)
    starts = [0, *np.cumsum(sizes)[:-1].tolist()]
    return x, starts, [covertree.Tree.build(covertree.unit(x[s : s + n])) for s, n in zip(starts, sizes)]


@pytest.mark.parametrize(("step", "tile"), [(1 << 14, 1 << 20), (1, 1 << 20), (1 << 40, 50)])
@pytest.mark.parametrize("cosine", [0.93, 0.5])
def test_walk_finds_the_links_of_all_pairs(monkeypatch, step, tile, cosine):
    monkeypatch.setattr(covertree, "STEP", step)
    monkeypatch.setattr(covertree, "TILE", tile)
    r = np.random.default_rng(6)
    centers = r.normal(size=(8, 16))
    x = np.concatenate([r.normal(size=(60, 16)), *[c + spread * r.normal(size=(20, 16)) for c in centers for spread in (0.02, 0.2, 0.5)]])
    sizes = [200, 40, len(x) - 240]
    x, starts, trees = blocks_of(x[r.permutation(len(x))], sizes)
    n, u, of = r.integers(1, 4, len(x)), covertree.unit(x), np.repeat(np.arange(3), sizes)
    pairs = [(0, 0), (0, 1), (1, 2), (2, 2)]
    ok = (u @ u.T >= cosine) & np.isin(of[:, None] * 3 + of[None, :], [a * 3 + b for i, j in pairs for a, b in ((i, j), (j, i))])
    np.fill_diagonal(ok, False)
    root = np.arange(len(x))
    while (after := np.minimum(root, np.where(ok, root[None, :], len(x)).min(axis=1))).tolist() != root.tolist():
        root = after
    links, got = covertree.walk(x, n, trees, starts, cosine, pairs)
    assert links.tolist() == (ok @ n).tolist() and got.tolist() == root.tolist()


def test_walk_of_points_that_no_ball_parts_takes_few_steps():
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 64))
    x[:30] = x[0] + 0.07 * r.normal(size=(30, 64))
    x, starts, trees = blocks_of(x[r.permutation(3000)], [1500, 1500])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        links, _ = covertree.walk(x, np.ones(3000, dtype=np.int64), trees, starts, 0.93)
    finally:
        sys.setprofile(None)
    u = covertree.unit(x)
    ok = u[:1500] @ u[1500:].T >= 0.93
    assert links.tolist() == [*ok.sum(axis=1), *ok.sum(axis=0)] and links.any()
    assert sum(calls.values()) < 2000


def test_near_vectors_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert covertree.near_vectors(d).count() == 0
    one = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, covertree.near_vectors(one).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError, match="between"):
        covertree.near_vectors(d, 1.0)


def test_cover_tree_keeps_its_rules():
    r = np.random.default_rng(5)
    u = covertree.unit(np.concatenate([r.normal(size=(300, 4)), np.repeat(r.normal(size=(5, 4)), 3, axis=0)]))
    t = covertree.Tree.unpack(covertree.Tree.build(u).pack())
    leaves = [k for k in range(len(t.center)) if t.first[k] == t.last[k]]
    assert sorted(t.center[leaves]) == list(range(len(u))) and sorted(t.order) == list(range(len(u)))
    for k in range(len(t.center)):
        points = t.order[t.lo[k] : t.hi[k]]
        assert covertree._apart(u[points], u[t.center[k]][None, :]).max() <= t.radius[k] + 1e-7
        children = range(t.first[k], t.last[k])
        if len(children):
            assert t.center[children[0]] == t.center[k]  # nested
            assert sum(t.hi[c] - t.lo[c] for c in children) == len(points)
            gaps = covertree._apart(u[t.center[list(children)]], u[t.center[list(children)]])[np.triu_indices(len(children), 1)]
            widest = max(t.radius[c] for c in children)
            if t.radius[k] > 1e-7:
                assert not len(gaps) or gaps.min() >= widest - 1e-7  # apart by more than their radius
                assert widest <= t.radius[k]

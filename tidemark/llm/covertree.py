"""Near duplicates among embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors of one label and length are points on the unit sphere, where cosine t is Euclidean distance sqrt(2 - 2t). Equal
vectors are one point with a count. A tree nests its centers: a node's center is also the center of its first child, every
point lies within the node's radius, and radii halve from level to level while centers of one level stay further
apart than the radius. Two walks go down pairs of nodes: a pair whose balls are further apart than the threshold is
dropped, a pair whose balls lie wholly within it links all its points at once, what is left is split. Where balls part
too little for that to pay (random directions in high dimension), the points of the two nodes meet in one matrix product,
in single precision with a margin for its rounding; what passes is compared in double precision.

The upper levels are tables of Spark: a node with more than ``CELL`` points is split around centers of a bounded sample,
by tasks that hold one salted piece of it, until every node is a block of at most that many points. Block
pairs come from a walk down the node table; the lower levels are built once a block. Neighbouring blocks travel together,
in groups of bounded size: a task walks all pairs of blocks between two groups. It returns counts a point and a spanning
forest of its links, never the links themselves.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Vectors
of different length are never linked. Nor do rows without an id link, and they have no component. Repeated rows are
vectors of their own and link with each other; rows that share an id share its component. Empty tables give no rows;
other columns are not read. Cosines within rounding of the threshold are decided by the double that numpy gives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, having, small, staged, staged_bytes
from .components import connected

#: Points of a block at most; points of a node's sample and children of a node in the upper levels.
CELL, SAMPLE, FANOUT = 2048, 256, 64
#: Components of the vectors of a group of blocks, about; a task holds two groups. A short vector counts as one of ``LEAST``.
GROUP, LEAST = 1 << 20, 64
#: A step down a pair of nodes costs about as much as comparing so many pairs of points in a matrix product.
STEP = 1 << 14
#: Pairs of points in a matrix product, and edges held before a forest stands for them.
TILE = 1 << 20
#: After so many upper levels a node is cut by digest: its points lie too close together for centers to part them.
LEVELS = 12
#: Bounds are widened by more than rounding can move them.
SLACK = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; no bit of a component is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _where(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix; where little is true, numpy finds it several times as fast in one dimension."""
    return np.divmod(np.flatnonzero(ok), ok.shape[1])


class Tree:
    """A cover tree as arrays. Node k has center ``center[k]``, radius ``radius[k]`` (to its furthest point), children
    ``first[k]`` to ``last[k]`` and points ``order[lo[k]:hi[k]]``; a node without children is one point."""

    FIELDS = (("center", np.int64), ("radius", np.float64), ("first", np.int64), ("last", np.int64), ("lo", np.int64), ("hi", np.int64), ("order", np.int64))

    def __init__(self, parts: dict[str, np.ndarray]):
        for name, _ in self.FIELDS:
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, u: np.ndarray) -> Tree:
        order = np.arange(len(u))
        d = _apart(u, u[:1])[:, 0]
        center, radius, first, last, lo, hi = [0], [float(d.max())], [0], [0], [0], [len(u)]
        bound, todo = [2.0], [0]
        far = {0: d}  # of a node's points to its center
        while todo:
            k = todo.pop()
            d, a, b = far.pop(k), lo[k], hi[k]
            if b - a == 1:
                continue
            points, r = order[a:b].copy(), bound[k] / 2
            while r >= radius[k] > 1e-7:  # levels at which the center alone covers all
                r /= 2
            split = radius[k] > 1e-7
            if split:
                near = d <= r
                near[points == center[k]] = True
                parts, points = [(center[k], points[near], d[near])], points[~near]
            else:  # points that no level parts: a child each
                parts, points = [(c, np.array([c]), np.zeros(1)) for c in [center[k], *points[points != center[k]].tolist()]], points[:0]
            while len(points):
                some = points[:64]
                d, alive = _apart(u[some], u[points]), np.ones(len(points), dtype=bool)
                for i, c in enumerate(some.tolist()):
                    if alive[i]:
                        d[i, i] = 0.0
                        near = alive & (d[i] <= r)
                        parts.append((c, points[near], d[i, near]))
                        alive &= ~near
                points = points[alive]
            first[k] = len(center)
            for c, members, dist in parts:
                n = len(center)
                order[a : a + len(members)] = members
                center.append(c)
                radius.append(float(dist.max()))
                first.append(0)
                last.append(0)
                lo.append(a)
                hi.append(a + len(members))
                bound.append(r)
                far[n] = dist
                todo.append(n)
                a += len(members)
            last[k] = len(center)
        return cls(dict(zip([n for n, _ in cls.FIELDS], map(np.array, (center, radius, first, last, lo, hi))), order=order))

    def pack(self) -> bytes:
        return np.array([len(self.center)]).tobytes() + b"".join(getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS)

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        n, at, parts = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
        for name, kind in cls.FIELDS:
            parts[name] = np.frombuffer(data, kind, -1 if name == "order" else n, at)
            at += 8 * n
        return cls(parts)


def _groups(edges: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest point that each of ``n`` points reaches."""
    root = np.arange(n)
    if not edges:
        return root
    u, v = (np.concatenate(x) for x in zip(*edges))
    while True:
        m = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, u, m)
        np.minimum.at(after, v, m)
        np.minimum.at(after, root[u], m)
        np.minimum.at(after, root[v], m)
        after = after[after]
        if (after == root).all():
            return root
        root = after


class Links:
    """Links of points counted with their copies (``n``), and a forest that stands for them: ``root`` is the smallest point
    that a point reaches by the links closed so far."""

    def __init__(self, n: np.ndarray):
        self.n, self.count, self.root = n, np.zeros(len(n), dtype=np.int64), np.arange(len(n))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        """Points ``p[k]`` and ``q[k]``."""
        np.add.at(self.count, p, self.n[q])
        np.add.at(self.count, q, self.n[p])
        self.join(p, q)

    def within(self, p: np.ndarray) -> None:
        """All pairs of ``p``."""
        self.count[p] += self.n[p].sum() - self.n[p]
        self.join(p, np.full(len(p), p[0]))

    def across(self, p: np.ndarray, q: np.ndarray) -> None:
        """All pairs of one of ``p`` and one of ``q``."""
        self.count[p] += self.n[q].sum()
        self.count[q] += self.n[p].sum()
        self.join(p, np.full(len(p), q[0]))
        self.join(q, np.full(len(q), p[0]))

    def matrix(self, p: np.ndarray, q: np.ndarray, ok: np.ndarray) -> None:
        """Points ``p[r]`` and ``q[c]`` where ``ok[r, c]``."""
        weight = ok.astype(np.float64)
        np.add.at(self.count, p, np.rint(weight @ self.n[q]).astype(np.int64))
        np.add.at(self.count, q, np.rint(self.n[p] @ weight).astype(np.int64))
        while (cross := ok & (self.root[p][:, None] != self.root[q][None, :])).any():  # a link a row and column joins trees
            r, c = np.flatnonzero(cross.any(axis=1)), np.flatnonzero(cross.any(axis=0))
            self.join(p[r], q[cross[r].argmax(axis=1)])
            self.join(p[cross[:, c].argmax(axis=0)], q[c])
            self.close()

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        new = self.root[p] != self.root[q]
        if new.any():
            self.edges.append((p[new], q[new]))
            self.held += int(new.sum())
            if self.held > TILE or len(self.edges) > 4096:
                self.close()

    def close(self) -> None:
        self.root = _groups([(np.arange(len(self.root)), self.root), *self.edges], len(self.root))
        self.edges, self.held = [], 0


def walk(x: np.ndarray, n: np.ndarray, trees: list[Tree], starts: list[int], cosine: float, pairs: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the points of blocks. ``x``: their scaled vectors, ``n``: copies of each, ``trees`` over ``x[start:]``;
    ``pairs`` of trees that are walked (the first with the last, if not given), a tree with itself for all pairs in it.
    Links count copies; root is the smallest point reached."""
    u = unit(x)
    low = u.astype(np.float32)
    reach = math.sqrt(2.0 - 2.0 * cosine)
    floor = np.float32(cosine - (x.shape[1] + 8) * 2.0**-23)  # twice what single precision can lose
    links = Links(n)
    below = lambda t, k: np.arange(t.first[k], t.last[k]) if t.last[k] > t.first[k] else np.array([k])

    def linked(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(p), dtype=bool)
        most = max(1, TILE // x.shape[1])
        for at in range(0, len(p), most):
            xp, xq = x[p[at : at + most]], x[q[at : at + most]]
            ok[at : at + most] = np.einsum("ij,ij->i", xp, xq) / np.sqrt(np.einsum("ij,ij->i", xp, xp) * np.einsum("ij,ij->i", xq, xq)) >= cosine
        return ok

    def compare(p: np.ndarray, q: np.ndarray, inner: bool) -> None:
        step = max(1, TILE // len(q))
        for at in range(0, len(p), step):
            rows, cols = p[at : at + step], q[at:] if inner else q
            r, c = _where(low[rows] @ low[cols].T >= floor)
            if len(r) * 16 <= len(rows) * len(cols):
                if inner:
                    r, c = r[r < c], c[r < c]
                ok = linked(rows[r], cols[c])
                links.add(rows[r[ok]], cols[c[ok]])
            else:
                dot = u[rows] @ u[cols].T
                ok = dot >= cosine
                r, c = _where(np.abs(dot - cosine) <= SLACK)
                ok[r, c] = linked(rows[r], cols[c])
                links.matrix(rows, cols, np.triu(ok, 1) if inner else ok)

    def down(a: Tree, sa: int, b: Tree, sb: int, same: bool) -> None:
        points = lambda t, s, k: s + t.order[t.lo[k] : t.hi[k]]
        apart = 0.0 if same else float(_apart(u[[sa + a.center[0]]], u[[sb + b.center[0]]])[0, 0])
        if apart > reach + a.radius[0] + b.radius[0] + SLACK:
            return
        if not same and apart + a.radius[0] + b.radius[0] <= reach - SLACK:
            return links.across(points(a, sa, 0), points(b, sb, 0))
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            inner = same and i == j
            p, q = points(a, sa, i), points(b, sb, j)
            if inner and 2 * a.radius[i] <= reach - SLACK:
                links.within(p)
                continue
            ci, cj = below(a, i), below(b, j)
            size = len(p) * len(q)
            if size <= STEP or 2 * len(ci) * len(cj) >= size:
                compare(p, q, inner)
                continue
            other, rj, one_j = u[sb + b.center[cj]].T, b.radius[cj], b.last[cj] == b.first[cj]
            found = []
            for at in range(0, len(ci), 512):
                ri = a.radius[ci[at : at + 512]]
                dot = u[sa + a.center[ci[at : at + 512]]] @ other
                # distance d is cosine 1 - d^2 / 2: without radii one number bounds the whole matrix
                bound = reach + SLACK + (ri[:, None] + rj[None, :] if ri.any() or rj.any() else 0.0)
                r, c = _where(dot >= 1.0 - bound * bound / 2.0)
                found.append((at + r, c, dot[r, c]))
            r, c, dot = (np.concatenate(part) for part in zip(*found))
            if inner:
                keep = r < c
                r, c, dot = r[keep], c[keep], dot[keep]
            ri, one_i = a.radius[ci], a.last[ci] == a.first[ci]
            single = one_i[r] & one_j[c]
            if (len(r) - single.sum()) * STEP >= size:
                compare(p, q, inner)
                continue
            s, t = sa + a.center[ci[r[single]]], sb + b.center[cj[c[single]]]
            ok = linked(s, t)
            links.add(s[ok], t[ok])
            r, c, dot = r[~single], c[~single], dot[~single]
            whole = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot)) + ri[r] + rj[c] <= reach - SLACK
            for k, m in zip(ci[r[whole]].tolist(), cj[c[whole]].tolist()):
                links.across(points(a, sa, k), points(b, sb, m))
            todo += list(zip(ci[r[~whole]].tolist(), cj[c[~whole]].tolist()))
            if inner:
                todo += [(k, k) for k in ci[~one_i].tolist()]

    for i, j in [(0, len(trees) - 1)] if pairs is None else pairs:
        down(trees[i], starts[i], trees[j], starts[j], i == j)
    links.close()
    return links.count, links.root


def _net(t: pa.Table) -> pa.Table:
    """Centers of a node's sample, ``most`` at most: its first point, then the point furthest from all before it while that
    is beyond half the node's radius."""
    x = _matrix(t["v"])
    u = unit(x)
    d = _apart(u, u[:1])[:, 0]
    picked, least = [0], d.copy()
    r, most = d.max() / 2, t["most"][0].as_py()
    while len(picked) < most and (far := int(least.argmax())) not in picked and (least[far] > r or len(picked) < 2):
        picked.append(far)
        least = np.minimum(least, _apart(u, u[far : far + 1])[:, 0])
    return pa.table({"node": t["node"].take(picked), "v": t["v"].take(picked)})


def _deal(points: pa.Table, centers: pa.Table) -> pa.Table:
    """Points to the child of their nearest center."""
    k = _apart(unit(_matrix(points["v"])), unit(_matrix(centers["v"]))).argmin(axis=1)
    node = [f"{n}/{i}" for n, i in zip(points["node"].to_pylist(), k.tolist())]
    return points.select(["c", "least", "n", "v"]).append_column("node", pa.array(node, pa.string()))


def _block(t: pa.Table) -> pa.Table:
    x = scaled(_matrix(t["v"]))
    u = unit(x)
    tree = Tree.build(u)
    short = x.astype(np.float32)  # as most tables hold them: half the bytes, if nothing is lost
    return pa.table({
        "node": t["node"].slice(0, 1), "center": pa.array([u[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radius[0]]),
        "c": pa.array([t["c"].to_pylist()], pa.list_(pa.int64())), "least": pa.array([t["least"].to_pylist()], pa.list_(pa.int64())), "n": pa.array([t["n"].to_pylist()], pa.list_(pa.int64())),
        "x": pa.array([(short if (short == x).all() else x).tobytes()], pa.binary()), "tree": pa.array([tree.pack()], pa.binary()),
    })


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _split(points: DataFrame, cell: int) -> list[DataFrame]:
    """(c, least, n, v, node) as parts in which every node has about ``cell`` points at most: staged ones, or ``points``."""
    parts, left = [], points
    for level in range(LEVELS + 1):
        big = staged(left.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > cell))
        if big.isEmpty():
            return [*parts, left]
        parts.append(staged(left.join(small(big), "node", "left_anti").select(points.columns)))
        wide = left.join(small(big), "node")
        salts = F.ceil(F.col("size") / cell).cast("int")
        if level == LEVELS:
            last = staged(wide.withColumn("node", F.concat_ws("/", "node", F.pmod(F.xxhash64("c"), salts))).select(points.columns))
            discard(big, *([left] if level else []))
            return [*parts, last]
        order = Window.partitionBy("node").orderBy(F.xxhash64("c"), "c")
        most = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(4 * F.col("size") / cell))).cast("int").alias("most")
        sample = wide.select("node", "c", "v", most).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= SAMPLE).drop("_i", "c")
        centers = staged(sample.groupBy("node").applyInArrow(_net, "node string, v array<double>"))
        own = wide.withColumn("salt", F.pmod(F.xxhash64("c", F.lit(level)), salts).cast("int")).drop("size")
        copies = centers.join(small(big), "node").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size")
        dealt = own.groupBy("node", "salt").cogroup(copies.groupBy("node", "salt")).applyInArrow(_deal, "c bigint, least bigint, n bigint, v array<double>, node string")
        after = staged(dealt.select(points.columns))
        discard(big, centers, *([left] if level else []))
        left = after
    raise AssertionError("unreachable")


def _block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(i, j) of blocks that may hold a pair within ``reach``, i = j included: a walk down the upper levels, a join a level.
    Pairs of two blocks are settled; the others go on, dealt to all cores."""
    leaves = blocks.select("node", "center", "radius")
    depth = blocks.agg(F.max(F.size(F.split("node", "/")))).first()[0] or 1
    at = lambda level: F.substring_index("node", "/", level)
    roots = leaves.groupBy(at(1).alias("i")).agg(F.max(F.col("node") == at(1)).alias("settled"))
    steps = [staged(roots.select("i", F.col("i").alias("j"), "settled"))]
    for level in range(2, depth + 1):
        under = leaves.withColumn("up", at(level - 1)).withColumn("k", at(level))
        centers = under.groupBy("up", "k").agg(F.min_by("center", "node").alias("center"))
        of_k = [F.first("center").alias("center"), F.max(distance(F.col("center"), F.col("_c")) + F.col("radius")).alias("radius"), F.max(F.col("node") == F.col("k")).alias("leaf")]
        balls = staged(under.select("k", "node", F.col("center").alias("_c"), "radius").join(centers, "k").groupBy("up", "k").agg(*of_k))
        a = balls.select(F.col("up").alias("i"), F.col("k").alias("a"), F.col("center").alias("ca"), F.col("radius").alias("ra"), F.col("leaf").alias("la"))
        b = balls.select(F.col("up").alias("j"), F.col("k").alias("b"), F.col("center").alias("cb"), F.col("radius").alias("rb"), F.col("leaf").alias("lb"))
        pairs = steps[-1].where(~F.col("settled")).repartition(blocks.sparkSession.sparkContext.defaultParallelism, "i", "j")
        met = pairs.join(a, "i").join(b, "j").where((F.col("i") != F.col("j")) | (F.col("a") <= F.col("b")))
        met = met.where((F.col("a") == F.col("b")) | (distance(F.col("ca"), F.col("cb")) <= reach + F.col("ra") + F.col("rb") + SLACK))
        steps.append(staged(met.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), (F.col("la") & F.col("lb")).alias("settled"))))
        discard(balls)
    settled = steps[0].where("settled")
    for step in steps[1:]:
        settled = settled.unionByName(step.where("settled"))
    out = staged(settled.select("i", "j"))
    discard(*steps)
    return out


def _tasks(blocks: DataFrame, pairs: DataFrame, group: int) -> DataFrame:
    """(p, q, i, j): the pairs of blocks with their pair of groups. A group is a run of blocks of one root in the order of
    the tree, of about ``group`` components."""
    sized = blocks.select("node", F.substring_index("node", "/", 1).alias("root"), (F.size("c") * F.greatest(F.size("center"), F.lit(LEAST)).cast("bigint")).alias("size"))
    before = F.sum("size").over(Window.partitionBy("root").orderBy("node")) - F.col("size")
    groups = staged(sized.select("node", F.concat_ws("#", "root", F.floor(before / group)).alias("group")))
    of = lambda node, name: small(groups).select(F.col("node").alias(node), F.col("group").alias(name))
    tasks = staged(pairs.join(of("i", "gi"), "i").join(of("j", "gj"), "j").select(F.least("gi", "gj").alias("p"), F.greatest("gi", "gj").alias("q"), "i", "j"))
    discard(groups)
    return tasks


def _visit(cosine: float):
    def visit(pairs: pa.Table, blocks: pa.Table) -> pa.Table:
        xs, ns, trees, starts, cs, leasts, place, at = [], [], [], [], [], [], {}, 0
        for r in blocks.sort_by("node").to_batches(max_chunksize=1):
            r = {name: r.column(name)[0] for name in ("node", "c", "least", "n", "x", "tree", "dims")}
            place[r["node"].as_py()] = len(starts)
            starts.append(at)
            cs.append(r["c"].values.to_numpy(zero_copy_only=False))
            leasts.append(r["least"].values.to_numpy(zero_copy_only=False))
            ns.append(r["n"].values.to_numpy(zero_copy_only=False))
            data, cells = r["x"].as_py(), len(cs[-1]) * r["dims"].as_py()
            xs.append(np.frombuffer(data, np.float64 if len(data) == 8 * cells else np.float32).astype(np.float64).reshape(len(cs[-1]), -1))
            trees.append(Tree.unpack(r["tree"].as_py()))
            at += len(cs[-1])
        c, least = np.concatenate(cs), np.concatenate(leasts)
        todo = sorted((place[i], place[j]) for i, j in zip(pairs["i"].to_pylist(), pairs["j"].to_pylist()))
        links, root = walk(np.concatenate(xs), np.concatenate(ns), trees, starts, cosine, todo)
        hit = np.flatnonzero(links)
        return pa.table({"c": c[hit], "links": links[hit], "a": least[hit], "b": least[root[hit]]})

    return visit


def near_vectors(vectors: DataFrame, cosine: float = 0.93, label: str = "label", vector: str = "embedding", id_col: str = "vec_id", cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: the other rows of its label at ``cosine`` or more, and the
    smallest id that links reach from it."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine lies between 0 and 1")
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    used = rows.where(usable)
    classes = staged(used.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("c", F.monotonically_increasing_id()))
    points = classes.select("c", "least", "n", "v", F.concat_ws(":", F.hex("label"), F.size("v")).alias("node"))
    parts = _split(points, cell)
    dealt = parts[0]
    for one in parts[1:]:
        dealt = dealt.unionByName(one)
    blocks = staged(dealt.groupBy("node").applyInArrow(_block, "node string, center array<double>, radius double, c array<bigint>, least array<bigint>, n array<bigint>, x binary, tree binary"))
    pairs = _block_pairs(blocks, math.sqrt(2.0 - 2.0 * cosine))
    tasks = _tasks(blocks, pairs, group)
    sent = staged(tasks.select("p", "q", F.explode(F.array("i", "j")).alias("node")).distinct())
    held = blocks.withColumn("dims", F.size("center")).drop("center", "radius").join(small(sent), "node")
    visits = tasks.groupBy("p", "q").cogroup(held.groupBy("p", "q"))
    met = staged(visits.applyInArrow(_visit(cosine), "c bigint, links bigint, a bigint, b bigint"))
    discard(blocks, pairs, tasks, sent, *[part for part in parts if part is not points])
    roots = connected(met.select("a", "b"))
    links = met.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "least", "n").join(links, "c", "left").join(roots.withColumnRenamed("node", "least"), "least", "left")
    known = staged(known.select("c", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id")))
    copied = F.col("n") > 1  # other classes are one row, which has the class's least id
    copies = staged(classes.where(copied).drop("n", "least").join(known.where(copied), "c").select(F.xxhash64("v").alias("h"), "label", "v", "n", "n_links", "component_id"))
    discard(classes, met)
    used, key = used.withColumn("h", F.xxhash64("v")), ["h", "label", "v"]  # sorting meets the digest first
    met = used.join(F.broadcast(copies), key) if staged_bytes(copies) <= BROADCAST_BYTES else having(used, copies, key, "n")
    linked = known.where(~copied).select(F.col("least").alias("vec_id"), "n_links", "component_id").unionByName(met.select("vec_id", "n_links", "component_id"))
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

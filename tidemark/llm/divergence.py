"""Source divergence audit: how far the sources of a language lie from each other, by Gustavson row accumulation.

Each (language, source) group is a sparse row of term shares. The divergence of two rows needs every kept term, also
those that one or both lack; but a lacking term has one share in a row, the row's zero share z. With f the divergence
of two shares, the sum over all V terms is

    V f(z_a, z_b) + U(a, b) + U(b, a) + sum over common terms of f(p_a, p_b) - f(p_a, z_b) - f(z_a, p_b) + f(z_a, z_b),

where U(a, b) sums f(p_a, z_b) - f(z_a, z_b) over a's terms. U needs only how often a row has each share. Common terms
are met through a term-major index: a row's terms scatter what their postings hold into a dense accumulator over the
peers, so no pair of postings becomes a row of Spark. Rows are dealt to blocks of groups and terms to blocks of
terms; a task holds two blocks of groups and one of terms, and hands back sums.

Null texts, languages and sources count as empty strings. A language without kept terms has divergence 0 between its
sources and no term rows. Repeated rows are documents of their own. Empty tables give no rows; other columns are not
read. A language with one source has no pair rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small, staged, word_table

#: ASCII letters; together with all bytes beyond ASCII they make terms.
TERMS = word_table(b"")
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: Groups and terms of a block, on average.
GROUPS, BLOCK_TERMS = 512, 2048
#: Distinct terms of its groups that a counting task holds before it hands them on.
HELD = 1 << 20


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term binary, n, d): occurrences and documents of each term of a group; each group also has a row
    without a term."""

    def run(batches):
        groups, held = {}, 0

        def rows():
            langs, sources, terms, ns, ds = [], [], [], [], []
            for (a, b), (n, d) in groups.items():
                langs += [a] * (len(n) + 1)
                sources += [b] * (len(n) + 1)
                terms += [None, *n]
                ns += [0, *n.values()]
                ds += [0, *map(d.__getitem__, n)]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], names=["lang", "source", "term", "n", "d"])

        from collections import Counter

        for batch in batches:
            for text, *key in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, d = groups.setdefault(tuple(key), (Counter(), Counter()))
                terms, before = text.translate(TERMS).split(), len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n) - before
                if held > HELD:
                    yield rows()
                    groups, held = {}, 0
        yield rows()

    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    found = read.mapInArrow(run, "lang string, source string, term binary, n bigint, d bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, all_n: Column, kinds: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (all_n + 2 kinds)), exact; 0 where there are no kinds."""
    top, low = (F.lit(SCALE).cast("decimal(11,0)") * (n.cast("decimal(19,0)") + 2)), (all_n.cast("decimal(19,0)") + 2 * kinds)
    return F.when(kinds == 0, F.lit(0).cast("bigint")).otherwise(1 + F.call_function("div", top, F.when(low > 0, low)))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


class _Side:
    """One block of groups in a task: names, zero shares, and cells ordered by group."""

    def __init__(self, t: pa.Table):
        code = t["source"].combine_chunks().dictionary_encode()
        self.names = np.array(code.dictionary.to_pylist(), dtype=object)
        of, z = code.indices.to_numpy(zero_copy_only=False), t["z"].to_numpy()
        self.z = np.zeros(len(self.names), dtype=np.int64)
        self.z[of] = z
        cell = ~t["p"].is_null().to_numpy()
        order = np.argsort(of[cell], kind="stable")
        self.of = of[cell][order]
        self.p = t["p"].filter(pa.array(cell)).to_numpy()[order]
        self.m = t["m"].filter(pa.array(cell)).to_numpy()[order]
        self.term = t["term_id"].filter(pa.array(cell)).to_numpy()[order]
        self.start = np.searchsorted(self.of, np.arange(len(self.names) + 1))

    def lone(self, other: _Side) -> np.ndarray:
        """U of each group with each peer of the other block."""
        out = np.zeros((len(self.names), len(other.names)), dtype=np.int64)
        for g in range(len(self.names)):
            none = _f(self.z[g], other.z)
            for at in range(self.start[g], self.start[g + 1], 4096):
                cut = slice(at, min(at + 4096, self.start[g + 1]))
                out[g] += (self.m[cut, None] * (_f(self.p[cut, None], other.z[None, :]) - none)).sum(axis=0)
        return out

    def common(self, other: _Side) -> np.ndarray:
        """Each group's terms go through the other block's term-major index into one accumulator over its peers."""
        order = np.argsort(other.term, kind="stable")
        term, peer, q = other.term[order], other.of[order], other.p[order]
        out = np.zeros((len(self.names), len(other.names)), dtype=np.int64)
        for g in range(len(self.names)):
            mine = slice(self.start[g], self.start[g + 1])
            lo, hi = np.searchsorted(term, self.term[mine]), np.searchsorted(term, self.term[mine], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            p, b = np.repeat(self.p[mine], n), peer[at]
            np.add.at(out[g], b, _f(p, q[at]) - _f(p, other.z[b]) - _f(self.z[g], q[at]) + _f(self.z[g], other.z[b]))
        return out


def _block_sums(key: tuple, t: pa.Table) -> pa.Table:
    lang, i, j, part = (x.as_py() for x in key)
    t = t.append_column("term_id", pc.fill_null(t["term"].combine_chunks().dictionary_encode().indices, -1))
    own = t["own"].to_numpy()
    a = _Side(t.filter(pa.array(own == i)))
    b = a if i == j else _Side(t.filter(pa.array(own == j)))
    if part < 0:
        sums = a.lone(b) + b.lone(a).T
        if part == -1:
            sums = sums + t["kinds"][0].as_py() * _f(a.z[:, None], b.z[None, :])
        there = np.ones(sums.shape, dtype=bool)
    else:
        sums = a.common(b)
        there = sums != 0
    if i == j:
        np.fill_diagonal(there, False)
    x, y = np.nonzero(there)
    s, x, y = sums[x, y], a.names[x], b.names[y]
    if i != j:
        s, x, y = np.concatenate([s, s]), np.concatenate([x, y]), np.concatenate([y, x])
    return pa.table({"lang": pa.array([lang] * len(s), pa.string()), "source": pa.array(x.tolist(), pa.string()), "item": pa.array(y.tolist(), pa.string()), "s": pa.array(s, pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, group_block: int = GROUPS, term_block: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language by divergence. Part
    ``term``: the ``top`` terms that a group uses more than its language, by what they add to the divergence.

    Kept terms are in ``least_docs`` documents of the language or more. Ties go to the smaller item in UTF-8."""
    counts = staged(term_counts(docs))
    cells = counts.where("term is not null")
    vocabulary = staged(cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d"))
    kept = staged(cells.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").withColumn("all_n", F.coalesce("all_n", F.lit(0)))
    groups = staged(groups)
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    langs = langs.join(vocabulary.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_all")), "lang", "left")
    langs = staged(langs.select("lang", "groups", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("lang_all", F.lit(0)).alias("lang_all")))
    of_group = staged(groups.join(small(langs), "lang").select("lang", "source", "all_n", "kinds", "groups", "lang_all", share(F.lit(0), F.col("all_n"), F.col("kinds")).alias("z")))
    shares = kept.join(small(of_group), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all_n"), F.col("kinds"))).withColumn("q", share(F.col("lang_n"), F.col("lang_all"), F.col("kinds")))
    shares = staged(shares.select("lang", "source", "term", "p", "q", "z", "kinds", "groups"))
    discard(kept)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")

    blocks = lambda column, size: F.ceil(F.greatest(F.col(column), F.lit(1)) / size).cast("int")
    own = F.pmod(F.xxhash64("source"), blocks("groups", group_block)).cast("int").alias("own")
    lone_parts = blocks("kinds", 512 * term_block)
    nothing = lambda kind: F.lit(None).cast(kind)
    columns = ["lang", "source", "term", "p", "z", "m", "kinds", "groups", "own", "part"]
    one = F.lit(1).cast("bigint").alias("m")
    met = shares.select("lang", "source", "term", "p", "z", one, "kinds", "groups", own, F.pmod(F.xxhash64("term"), blocks("kinds", term_block)).cast("int").alias("part"))
    lone = shares.groupBy("lang", "source", "p", "z", "kinds", "groups").agg(F.count("*").alias("m")).select("lang", "source", nothing("binary").alias("term"), "p", "z", "m", "kinds", "groups", own, (-1 - F.pmod(F.col("p"), lone_parts)).cast("int").alias("part"))
    marks = of_group.select("lang", "source", nothing("binary").alias("term"), nothing("bigint").alias("p"), "z", one, "kinds", "groups", own, F.explode(F.transform(F.sequence(F.lit(1), lone_parts), lambda x: -x)).alias("part"))
    rows = met.select(columns).unionByName(lone.select(columns)).unionByName(marks.select(columns))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks("groups", group_block) - 1))).withColumn("i", F.least("own", "_with")).withColumn("j", F.greatest("own", "_with"))
    sums = rows.select("lang", "i", "j", "part", "own", "source", "term", "p", "z", "m", "kinds").groupBy("lang", "i", "j", "part").applyInArrow(_block_sums, "lang string, source string, item string, s bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("s").alias("value")).withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    discard(counts, vocabulary, groups, langs)
    return pairs.unionByName(terms)

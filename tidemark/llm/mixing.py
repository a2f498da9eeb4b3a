"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the mean number of copies of its words. The whole part is certain for each
document; what is lacking is sampled: documents have their own inclusion probabilities p, smaller the longer a
document is against its source's mean, so that no long document carries a source's repeats. Their odds are
p/(1-p) = t * (mean/size)^(1/2), and t is what makes the sizes times p sum to what is lacking. Documents are ranked by
their random odds u/(1-u) over their inclusion odds; the first in that order are taken as long as their words fit. Of
the document that does not fit and all after it, the one whose words come nearest to what is still lacking closes
the gap, if any comes nearer than none. u is a hash of the id and the seed, so reruns agree.

A sample's size is a number of words, not of documents: that is what targets are in. The order is cut without sorting a source in one task:
the ratio r becomes the slice of r/(1+r); words are first summed per (source, slice) with map-side combine, the
slice that the cut falls in is sliced again, and only that last sliver is ordered by a window.

Null text has size 0 and is never taken; null sources form one source, last in order. Rows that share an id and a
size share their u and so stand together in the order; the place in the table breaks their tie. Sources without words have
target 0. An empty table gives an empty mix. Only id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, discard, keyed, own_columns, staged, staged_bytes

WEIGHTS = (3.0, 1.0, 2.0)
SLICES = 4096
#: Sizes are told apart by powers of 2^(1/4) when inclusion odds are set, so a source has at most 4 * 63 of them.
SIZE_STEPS = 4
ROUNDS = 60


def words(text: Column) -> Column:
    """Number of maximal runs of non-space bytes: ASCII white space only; null: 0."""
    marks = F.translate(F.regexp_replace(text, f"[^{SPACE}]+", "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks).cast("bigint"), F.lit(0).cast("bigint"))


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Adds ``place`` (from 0): rank of each distinct value by code point, null last, without one task
    ordering all: ranges are sorted apart and offset by the counts of the ranges before."""
    key = F.struct(F.col(column).isNull().alias("n"), F.col(column).alias("v"))
    parted = staged(names.withColumn("_k", key).repartitionByRange("_k").withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in parted.groupBy("_p").count().collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    offset = F.coalesce(*[F.when(F.col("_p") == p, F.lit(o)) for p, o in offsets]) if offsets else F.lit(0)
    return parted.withColumn("place", (F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1 + offset).cast("bigint")).drop("_k", "_p")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, place, source_size, target): ``share`` of all words dealt by weight; a target stops at
    ``most`` times its source's size and the excess is dealt again among those below."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = staged(ranked(sizes, "source").withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size")))
    total = s.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # Water filling: a level caps sources, which raises the level of the rest; sums only, each round.
    level = -1.0
    while True:
        capped = (F.col("cap") < F.lit(level) * F.col("w")) if level >= 0 else F.lit(False)
        row = s.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        new = (share * total - row["full"]) / row["w"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return s.select("source", "place", "source_size", F.least("cap", F.lit(max(level, 0.0)) * F.col("w")).alias("target"))


def _step(size: Column) -> Column:
    """The power of 2^(1/SIZE_STEPS) next to a size."""
    return F.round(F.log2(F.greatest(size, F.lit(1)).cast("double")) * SIZE_STEPS).cast("int")


def inclusion(goal: DataFrame, steps: DataFrame) -> DataFrame:
    """``goal`` (source, lack, mean, ...) with ``odds``: a map from a size's step to inclusion odds, null if nothing is lacking.

    ``steps``: (source, step, n) with the words of all documents of a size. t is found by halving an interval of its
    logarithm, in one SQL expression a source; the largest t leaves a source short by less than its rounding."""
    bins = steps.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("step", F.col("n").cast("double").alias("n")))).alias("bins")).withColumnRenamed("source", "_s")
    met = goal.join(bins, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    factor = lambda b: F.sqrt(F.col("mean") / F.pow(F.lit(2.0), b["step"] / F.lit(float(SIZE_STEPS))))
    met = met.withColumn("bins", F.transform("bins", lambda b: F.struct(b["step"].alias("step"), b["n"].alias("n"), factor(b).alias("m"))))
    def narrower(span: Column, _: Column) -> Column:
        middle = (span["lo"] + span["hi"]) / 2
        words = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["n"] / (1 + F.exp(-middle) / b["m"]))
        return F.when(words < F.col("lack"), F.struct(middle.alias("lo"), span["hi"].alias("hi"))).otherwise(F.struct(span["lo"].alias("lo"), middle.alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi")), narrower, lambda span: (span["lo"] + span["hi"]) / 2)
    met = met.withColumn("t", F.when(F.col("lack") > 0, found))
    odds = F.map_from_arrays(F.transform("bins", lambda b: b["step"]), F.transform("bins", lambda b: F.exp("t") * b["m"]))
    return met.withColumn("odds", F.when(F.col("t").isNotNull(), odds)).drop("bins", "t")


def _by_source(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with a staged table of one row a source: broadcast below a checked size, else a join that adaptive
    execution splits where a source is hot."""
    right = sources.withColumnRenamed("source", "_s")
    right = F.broadcast(right) if staged_bytes(sources) <= BROADCAST_BYTES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, ...) with their source's figures, inclusion probability and place v in the order."""
    odds = F.element_at("odds", _step(F.col("size")))
    # the ratio decides the order everywhere; v is its place in (0, 1)
    r = F.col("u") / (1 - F.col("u")) / odds
    some = F.col("size") > 0
    return _by_source(rows, sources).withColumn("inclusion", F.when(some, odds / (1 + odds))).withColumn("v", F.when(some, r / (1 + r))).drop("odds")


def _slices() -> tuple[Column, Column]:
    one = F.least(F.floor(F.col("v") * SLICES), F.lit(SLICES - 1)).cast("int")
    return one, F.least(F.floor((F.col("v") * SLICES - one) * SLICES), F.lit(SLICES - 1)).cast("int")


def _order() -> Column:
    return F.struct("v", "id", "size", "k")


def _taken() -> Column:
    """Whether a placed row stands before its source's cut (s1, s2, last)."""
    one, two = _slices()
    place, mark = F.struct(one.alias("a"), two.alias("b")), F.struct(F.col("s1").alias("a"), F.col("s2").alias("b"))
    return F.coalesce(F.col("v").isNotNull() & F.col("s1").isNotNull() & ((place < mark) | ((place == mark) & F.col("last").isNotNull() & (_order() <= F.col("last")))), F.lit(False))


def decisions(rows: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """One row a source (staged): its figures, inclusion odds by size, the cut of its order and the document that closes the gap.

    ``rows`` is staged: (id, source, size, u, k)."""
    steps = staged(rows.where("size > 0").groupBy("source", _step(F.col("size")).alias("step")).agg(F.sum("size").alias("n"), F.count("*").alias("docs")))
    goal = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    lack = F.floor(F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)) + 0.5).cast("bigint")
    means = staged(steps.groupBy("source").agg((F.sum("n") / F.sum("docs")).alias("mean")))
    aimed = _by_source(goal.withColumn("certain", F.floor(ratio + F.lit(1e-12)).cast("bigint")).withColumn("lack", lack), means, "left")
    sources = staged(inclusion(aimed, steps).drop("place", "mean"))
    placed = staged(_placed(rows, sources).where("v is not null").select("source", "lack", "v", "id", "size", "k"))
    one, two = _slices()

    def cut(sums: DataFrame) -> DataFrame:
        """Per source, the last slice that starts before what is lacking, and the words before it."""
        w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        at = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0).cast("bigint")))
        return at.where(F.col("before") < F.col("lack")).groupBy("source").agg(F.max(F.struct("slice", "before")).alias("m")).select("source", F.col("m.slice").alias("slice"), F.col("m.before").alias("before"))

    first = staged(cut(placed.groupBy("source", "lack", one.alias("slice")).agg(F.sum("size").alias("n")).withColumn("base", F.lit(0).cast("bigint"))).select("source", F.col("slice").alias("s1"), F.col("before").alias("b1")))
    second = staged(cut(_by_source(placed, first).where(one == F.col("s1")).groupBy("source", "lack", F.col("b1").alias("base"), two.alias("slice")).agg(F.sum("size").alias("n"))).select("source", F.col("slice").alias("s2"), F.col("before").alias("b2")))
    marks = staged(_by_source(first, second))
    # only the sliver around the cut is ordered: about 2^-24 of a source
    sliver = _by_source(placed, marks).where((one == F.col("s1")) & (two == F.col("s2")))
    w = Window.partitionBy("source").orderBy("v", "id", "size", "k").rowsBetween(Window.unboundedPreceding, 0)
    edge = sliver.withColumn("upto", F.col("b2") + F.sum("size").over(w))
    # sums only grow, so those that fit come first; the cut lies behind the last of them
    fits = F.col("upto") <= F.col("lack")
    last = staged(edge.groupBy("source").agg(F.max(F.when(fits, _order())).alias("last"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.min("b2")).alias("done")))
    cuts = staged(_by_source(marks.drop("b1", "b2"), last))
    # what closes the gap: the document behind the cut that brings the sum nearest, the earliest of these
    gap = F.col("lack") - F.col("done")
    after = _by_source(placed, cuts).where(~_taken() & (F.col("size") < 2 * gap))
    close = staged(after.groupBy("source").agg(F.min_by(_order(), F.struct(F.abs(gap - F.col("size")).alias("d"), "v", "id", "k")).alias("close")))
    out = staged(_by_source(_by_source(sources, cuts, "left").drop("done"), close, "left"))
    discard(steps, goal, means, sources, placed, first, second, marks, last, cuts, close)
    return out


def _figures(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, key: str) -> list[Column]:
    u = ((F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))).alias("u")
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), u, F.col(key).alias("k")]


def _copied(rows: DataFrame, sources: DataFrame) -> DataFrame:
    more = F.coalesce(_taken() | (F.col("v").isNotNull() & _order().eqNullSafe(F.col("close"))), F.lit(False))
    return _placed(rows, sources).withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + F.when(more, 1).otherwise(0)).otherwise(0).cast("bigint"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(id, size, source_size, target, copies, taken, inclusion) of every row. ``copies`` is at most ceil(target/size);
    ``inclusion`` is the probability of the copy that is sampled, null where none is."""
    docs, key = keyed(docs)
    rows = staged(docs.select(*_figures(docs, id_col, text_col, source_col, seed, key)))
    out = _copied(rows, decisions(rows, share, most, weights))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "inclusion")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """Every row as often as the mix takes it, all columns as they were.

    Texts are read twice, to size and to copy, and neither written nor shuffled while the sources are few enough to
    be broadcast: each row finds its copies from its own figures and its source's decisions."""
    docs, key = keyed(docs)
    columns = own_columns(docs.drop(key))
    figures = _figures(docs, id_col, text_col, source_col, seed, key)
    rows = staged(docs.select(*figures))
    sources = decisions(rows, share, most, weights)
    discard(rows)
    whole = docs.select(F.struct(*columns).alias("doc"), *figures)
    return _copied(whole, sources).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc.*")

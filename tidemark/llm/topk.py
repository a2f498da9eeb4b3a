"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Queries and candidates are packed in blocks of bounded size; each
pair of blocks is one row of an equi-join. In a pair, every dimension is a term: its posting list holds
the candidates with a non-zero weight, and each query scatters ``weight * posting`` into a dense
score array. Partition selection keeps the k best of the pair, and a window merges the pairs.

Vectors that are null or hold null or non-finite components take no part, nor do null ids. An empty vector has score 0 with all. Rows
that share a query's id count as the query's own. Repeated query rows each give their k results. Ties go
to the smaller id. Empty tables give no rows; only the id and the vector column are read. Components and scores are 64-bit
integers: blocks whose scores might pass that are summed in integers of any size, and a component or score that
does pass it is an error, never a wrapped number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Bytes of a block of vectors at most, unless a single vector is longer.
BLOCK_BYTES = 16 << 20
LIMIT = 1 << 63


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    def whole(x):
        scaled = x.cast("double") * F.lit(scale)
        return F.when((scaled >= float(LIMIT)) | (scaled < -float(LIMIT)), F.raise_error(F.lit("a scaled component passes 64 bits")).cast("bigint")).otherwise(F.floor(scaled).cast("bigint"))

    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite)
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, whole).alias("v"))


def _packed(rows: DataFrame, blocks: int, side: str) -> DataFrame:
    """One row per block: ids and a ragged matrix as bytes. Blocks are dealt round robin."""

    def run(batches):
        from pyspark import TaskContext

        ids, lengths, values = [], [], []
        for batch in batches:
            column = batch.column(1)
            ids.append(batch.column(0).to_numpy())
            lengths.append(np.diff(column.offsets.to_numpy()))
            values.append(column.flatten().to_numpy())
        if sum(map(len, ids)):
            order = np.argsort(np.concatenate(ids), kind="stable")
            lens = np.concatenate(lengths)
            start = np.cumsum(lens) - lens
            wide = np.zeros((len(order), max(1, int(lens.max()))), dtype=np.int64)
            row = np.repeat(np.arange(len(lens)), lens)
            wide[row, np.arange(len(row)) - start[row]] = np.concatenate(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(ids)[order].astype("<i8").tobytes()]), pa.array([wide.shape[1]], pa.int32()), pa.array([wide[order].astype("<i8").tobytes()])],
                names=[f"{side}b", f"{side}_ids", f"{side}_dims", f"{side}_values"],
            )

    return rows.repartition(blocks).mapInArrow(run, f"{side}b int, {side}_ids binary, {side}_dims int, {side}_values binary")


def block_scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of every query row with every candidate row, a term at a time; 0 for a query's own rows."""
    dims = min(q.shape[1], c.shape[1])
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    # integers of any size where 64 bits might not do
    kind = np.int64 if most(q) * most(c) * max(dims, 1) < LIMIT else object
    q, c = q.astype(kind), c.astype(kind)
    postings = []
    for d in range(dims):
        at = np.flatnonzero(c[:, d])
        postings.append((slice(None), c[:, d].copy()) if 2 * len(at) > len(c) else (at, c[at, d]))
    scores = np.zeros((len(q), len(c)), dtype=kind)
    for row, weights in zip(scores, q):
        for d in np.flatnonzero(weights[:dims]):
            at, values = postings[d]
            row[at] += weights[d] * values
    scores[own] = 0
    if kind is object:
        if scores.size and max(abs(scores.max()), abs(scores.min())) >= LIMIT:
            raise OverflowError("a score passes 64 bits")
        scores = scores.astype(np.int64)
    return scores


def best_of(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k highest scores besides its own; of equal ones at the edge the leftmost."""
    kept = np.where(own, np.iinfo(np.int64).min, scores)
    n = kept.shape[1]
    k = min(k, n)
    edge = np.partition(kept, n - k, axis=1)[:, n - k, None]
    above, ties = kept > edge, kept == edge
    return (above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))) & ~own


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by integer inner product.

    ``queries`` and ``candidates`` are (id, v) as ``quantised`` returns them. Blocks have a fixed size, so a
    task's memory does not grow with the input; work is queries times candidates, as the search demands."""
    spark = queries.sparkSession
    sized = lambda rows: rows.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.max(F.size("v")), F.lit(1)), F.lit(1)).alias("dims")).first()
    blocks = lambda row, most: max(1, -(-row["n"] // max(1, min(most, BLOCK_BYTES // (8 * row["dims"])))))
    nq, nc = blocks(sized(queries), QUERY_BLOCK), blocks(sized(candidates), CANDIDATE_BLOCK)
    cores = spark.sparkContext.defaultParallelism
    nc = max(nc, -(-cores // nq)) if nc > 1 else nc
    left = _packed(queries, nq, "q").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = _packed(candidates, nc, "c").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    pairs = left.repartition(nq * nc, "qb", "cb").join(right.repartition(nq * nc, "qb", "cb").hint("merge"), ["qb", "cb"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
                q = np.frombuffer(r["q_values"], "<i8").reshape(len(q_ids), -1)
                c = np.frombuffer(r["c_values"], "<i8").reshape(len(c_ids), -1)
                for lo in range(0, len(q_ids), 128):
                    ids = q_ids[lo : lo + 128]
                    own = ids[:, None] == c_ids[None, :]
                    scores = block_scores(q[lo : lo + 128], c, own)
                    # ids are in order within a block, so the place breaks ties
                    row, best = np.nonzero(best_of(scores, own, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), r["qb"], dtype=np.int32)), pa.array((row + lo).astype(np.int32)), pa.array(ids[row]), pa.array(c_ids[best]), pa.array(scores[row, best])],
                        names=["qb", "place", "query_id", "vec_id", "score"],
                    )

    found = pairs.select("qb", "q_ids", "q_values", "c_ids", "c_values").mapInArrow(run, "qb int, place int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "qb", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import discard, shared_dir, staged, staged_bytes

__all__ = ["BROADCAST_BYTES", "LOWER", "SPACE", "UPPER", "discard", "fresh", "having", "keyed", "keep_rows", "own_columns", "shared_dir", "small", "staged", "staged_bytes", "table", "word_table"]

#: ASCII white space that separates words; the same six bytes ``bytes.split()`` uses.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Staged keys of at most this many bytes are broadcast; more are shuffled with the rows they select.
BROADCAST_BYTES = 4 << 20
#: A key with more than one in HOT of the rows counted is hot; so at most HOT keys are.
HOT = 1024


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as they are, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def word_table(kept: bytes) -> bytes:
    """For ``bytes.translate``: A-Z become a-z, other ASCII bytes outside ``kept`` become spaces, the rest stays; what
    ``split()`` then returns are the words of a UTF-8 text."""
    letters = UPPER.lower().encode() + kept
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in letters else 32 for c in range(256))


def small(rows: DataFrame) -> DataFrame:
    """A staged table, to be broadcast where its files are small; else its join shuffles."""
    return F.broadcast(rows) if staged_bytes(rows) <= BROADCAST_BYTES else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def having(rows: DataFrame, marks: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Rows whose ``keys`` are in ``marks`` (a staged table; keys unique), with what else ``marks`` holds.

    ``n`` of ``marks`` counts the rows of its key, give or take a factor that all keys share. Hot keys, fewer than HOT by
    what hot means, are broadcast, so their rows stay where they are read; the others meet by a shuffle in which no key is
    hot. Rows with a null key go, as in any join. ``rows`` is read twice: stage what is dear."""
    total = marks.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    names = [f"_having_{i}" for i in range(len(keys))]
    right = marks.select(*[F.col(k).alias(name) for k, name in zip(keys, names)], *[c for c in marks.columns if c not in keys])
    hot = F.broadcast(right.where(F.col(n) * HOT > total))
    on = [F.col(k) == F.col(name) for k, name in zip(keys, names)]
    here = rows.join(hot, on)
    there = rows.join(hot, on, "left_anti").join(right.where(F.col(n) * HOT <= total), on)
    return here.unionByName(there).drop(*names)


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def keyed(docs: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """(``docs`` with a key column, its name): a struct of two longs that names a row alike in every read.

    Rows of a Parquet scan are named by their file (64-bit hash of its path) and their place in it, so no copy of the
    table is needed. Any other frame is staged with row numbers first, since Spark may deal its
    rows differently each time."""
    key = fresh(docs, name)
    if "_metadata" not in docs.columns and _is_scan(docs):
        try:
            return docs.withColumn(key, F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("f"), F.col("_metadata.row_index").alias("i"))), key
        except Exception as error:  # a source without row positions
            if "FIELD_NOT_FOUND" not in str(error) and "UNRESOLVED" not in str(error):
                raise
    return staged(docs.withColumn(key, F.struct(F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("i")))), key


def keep_rows(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (staged; its one column is ``f``, ``i`` in a struct named k)."""
    small = staged_bytes(gone) <= BROADCAST_BYTES
    keys = gone.select(F.col("k").alias(fresh(docs, "gone")))
    right = F.broadcast(keys) if small else keys
    return docs.join(right, F.col(key) == F.col(keys.columns[0]), "left_anti")



"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Tables staged by the build that runs now, innermost last.
_MADE: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory. Where none is set, a local session gets a temporary one; on a
    cluster, whose executors cannot read such a folder, this raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with replicated storage: a lost executor costs only its running tasks."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _MADE.get():
        _MADE.get()[-1].append(out)
    return out


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has finished."""
    for table in tables:
        fs, where = _filesystem(table.sparkSession, table.staged_path)
        fs.delete(where, True)


def staged_bytes(table: DataFrame) -> int:
    """Size of a staged table's files."""
    fs, where = _filesystem(table.sparkSession, table.staged_path)
    return fs.getContentSummary(where).getLength()


def tidied(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``build`` with its result written and every other table deleted that it staged on the way."""

    @functools.wraps(build)
    def call(*args: object, **options: object) -> DataFrame:
        made: list[DataFrame] = []
        token = _MADE.set((*_MADE.get(), made))
        out = None
        try:
            out = build(*args, **options)
            out = out if hasattr(out, "staged_path") else staged(out)
        finally:
            _MADE.reset(token)
            gone = {t.staged_path: t for t in made if out is None or t.staged_path != out.staged_path}
            discard(*gone.values())
        if _MADE.get():
            _MADE.get()[-1].append(out)
        return out

    return call

"""Session helpers: defaults for local runs, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session in UTC, for tests and the bench; a cluster's own settings are left alone."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once a session; the driver's copy is the only one needed."""
    sc = spark.sparkContext
    if not getattr(sc, "_tidemark_shipped", False):
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._tidemark_shipped = True
    return spark

"""Least squares for many groups at once: sums by group, then sweeps over columns. Nothing comes to the driver.

A regressor that a group lacks is a column of zeros; its sum of squares is set to 1, so that it gets coefficient 0 and
leaves the others alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its sum of squares means collinear regressors.
COLLINEAR = 1e-10


def cell(i: int | str, j: int | str) -> str:
    return f"m_{min(str(i), str(j))}_{max(str(i), str(j))}"


def sums(rows: DataFrame, keys: list[str], y: str, xs: list[str], weight: str | None = None, aggregate=F.sum) -> list[Column]:
    """All weighted sums of products of [1, xs] and y, named by ``cell``: 0 is the intercept, the last index is y."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    names = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    return [aggregate(w * a * b).alias(cell(i, j)) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]


def sweep(table: DataFrame, k: int, size: int) -> DataFrame:
    """One pivot of the symmetric sweep: after all regressors the matrix holds minus the inverse, the coefficients and the
    residual sum of squares. A pivot that has vanished makes its row null."""
    d = F.when(F.col(cell(k, k)) > COLLINEAR * F.col(f"s_{k}"), F.col(cell(k, k)))
    out = {}
    for i in range(size):
        for j in range(i, size):
            if i == j == k:
                out[cell(i, j)] = -1 / d
            elif k in (i, j):
                out[cell(i, j)] = F.col(cell(i, j)) / d
            else:
                out[cell(i, j)] = F.col(cell(i, j)) - F.col(cell(i, k)) * F.col(cell(k, j)) / d
    return table.withColumns(out)


def solved(table: DataFrame, xs: int, absent_ok: bool = True) -> DataFrame:
    """``table`` of cells with all of [1, xs] swept: ``b0``... are coefficients, ``v{i}_{j}`` the inverse of X'X."""
    size = xs + 2
    table = table.withColumns({f"s_{k}": F.when(F.col(cell(k, k)) == 0, 1.0).otherwise(F.col(cell(k, k))) if absent_ok else F.col(cell(k, k)) for k in range(xs + 1)})
    table = table.withColumns({cell(k, k): F.col(f"s_{k}") for k in range(xs + 1)})
    for k in range(xs + 1):
        table = sweep(table, k, size)
    named = {f"b{k}": F.col(cell(k, xs + 1)) for k in range(xs + 1)} | {f"v{i}_{j}": -F.col(cell(i, j)) for i in range(xs + 1) for j in range(i, xs + 1)}
    return table.withColumns(named | {"rss": F.col(cell(xs + 1, xs + 1))}).drop(*[cell(i, j) for i in range(size) for j in range(i, size)], *[f"s_{k}" for k in range(xs + 1)])


def inverse(i: int, j: int) -> str:
    return f"v{min(i, j)}_{max(i, j)}"


def regressions(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, b0..., v...): least squares of y on [1, xs] in every group; rows with a null go."""
    r = rows.select(*keys, y, *xs).na.drop(subset=[y, *xs])
    return solved(r.groupBy(*keys).agg(F.count("*").alias("n"), *sums(r, keys, y, xs)), len(xs))

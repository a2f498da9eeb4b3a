"""Tail probabilities as Column expressions: no driver scalar, no Python worker, any number of settings at once."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the series and of the continued fraction of the error function; either is exact to 1e-14 on its side of SPLIT.
SERIES, FRACTION, SPLIT = 80, 80, 2.0


def _steps(first: int, last: int, by: int = 1) -> Column:
    return F.sequence(F.lit(first), F.lit(last), F.lit(by))


def complementary_error(z: Column) -> Column:
    """erfc of z >= 0. Up to 2 by the series of positive terms z (2 z^2)^n / (2 n + 1)!!, beyond by the continued
    fraction, so that small tails keep their relative accuracy. Null stays null."""
    z = z.cast("double")
    start = F.struct(z.alias("term"), z.alias("sum"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * z * z / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * F.aggregate(_steps(1, SERIES), start, add, lambda acc: acc["sum"])
    far = F.exp(-z * z) / math.sqrt(math.pi) / F.aggregate(_steps(FRACTION, 1, -1), z, lambda acc, k: z + k / 2 / acc)
    return F.when(z <= SPLIT, near).when(z > SPLIT, far)


def chi_square_tail(x: Column) -> Column:
    """P(X >= x) of chi-square with one degree of freedom; null for null."""
    return complementary_error(F.sqrt(x / 2))


def student_tail(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with a whole number of degrees of freedom of at least 1; null for null, below 1 null.

    The angle of t turns the density into a power of the cosine, whose integral is a finite sum of df / 2 terms."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, odd = F.cos(angle) ** 2, df % 2 == 1
    n = F.floor(df / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        # odd: 1, 2/3, 2*4/(3*5), ...; even: 1, 1/2, 1*3/(2*4), ...
        grown = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["term"] * grown * c2).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    total = F.when(n < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, add, lambda acc: acc["sum"]))
    inside = F.when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when((df >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))

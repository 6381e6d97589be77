"""Column expressions shared by the operators. Nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consistency factor of the median absolute deviation for normal data.
MAD_SCALE = 1.4826


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ppm_step(ppm: float) -> float:
    """Width of a bin of ``ppm`` in the logarithm of m/z."""
    return math.log1p(ppm * 1e-6)


def log_bin(mz, ppm: float) -> Column:
    return F.floor(F.log(as_col(mz)) / F.lit(ppm_step(ppm))).cast("bigint")


def ppm_error(observed, reference) -> Column:
    return (as_col(observed) - as_col(reference)) / as_col(reference) * F.lit(1e6)


def weighted_mean(value, weight) -> Column:
    """Aggregate: mean by weight, or the plain mean where no weight is left."""
    v, w = as_col(value), as_col(weight)
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.avg(v))


def md5_int(*key) -> Column:
    """A reproducible integer below 2**32 of the key's text; the same in other engines."""
    text = F.concat_ws("|", *(F.lit(k).cast("string") if not isinstance(k, Column) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def lerp(x, xs: Column, ys: Column) -> Column:
    """Linear interpolation in ascending array ``xs`` with values ``ys``, held at the ends."""
    x = as_col(x)
    n = F.size(xs)
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(xs, lambda v: v <= x)), n - 1))
    at = lambda a, k: F.try_element_at(a, k)
    x0, x1, y0, y1 = at(xs, i), at(xs, i + 1), at(ys, i), at(ys, i + 1)
    inside = y0 + (x - x0) * F.try_divide(y1 - y0, x1 - x0)
    return F.when(x <= xs[0], ys[0]).when(x >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inside)


def running_sums(y: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values of a short array."""
    return F.aggregate(y, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def isotonic(sums: Column) -> Column:
    """Non-decreasing least-squares fit by the max-min formula, from the ``running_sums`` column."""
    n = F.size(sums) - 1
    mean = lambda a, b: (F.get(sums, b + 1) - F.get(sums, a)) / (b - a + 1)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda a: F.array_min(F.transform(F.sequence(i, n - 1), lambda b: mean(a, b))))),
    )

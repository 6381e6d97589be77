"""Multiple testing and occupancy probabilities."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Modulus of keyed numbers.
PRIME = 2**31 - 1


def keyed(x: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """Reproducible numbers below ``PRIME`` of the whole numbers ``x``, other ones for each ``rep``: a cube modulo a
    prime, with factors by md5. 64-bit arithmetic is enough, so other engines have the same."""
    draw = lambda what: int(hashlib.md5(f"{seed}|{rep}|{what}".encode()).hexdigest()[:8], 16)
    a, b = 1 + draw("a") % (PRIME - 1), draw("b") % PRIME
    u = (x % PRIME * a + b) % PRIME
    return (u * u % PRIME * u + x) % PRIME


def bh(df: DataFrame, p: str = "p", on: list[str] | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values of each group: running minimum of p * n / rank from the largest p."""
    on = ["dataset_id"] if on is None else on
    by = Window.partitionBy(*on)
    up = by.orderBy(p)
    r = df.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count("*").over(by))
    down = by.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")


#: Balls times bins up to which occupancies are found ball by ball.
STEPS = 1 << 22


def occupancy_tail(n_bins: int, n_balls: int, observed: int) -> float:
    """Probability that ``n_balls`` thrown at random into ``n_bins`` bins fill at least ``observed``.

    Small cases go ball by ball; others sum the probabilities of each number of filled bins outwards from
    the observed one, each from a contour integral. Both agree to 1e-8 of the value."""
    if n_balls <= 0 or observed <= 0:
        return 1.0
    if observed > min(n_bins, n_balls):
        return 0.0
    return _tail_by_balls(n_bins, n_balls, observed) if n_balls * n_bins <= STEPS else _tail_by_integrals(n_bins, n_balls, observed)


def _tail_by_balls(n_bins: int, n_balls: int, observed: int) -> float:
    j = np.arange(n_bins + 1, dtype=np.float64)
    stay, grow = j / n_bins, (n_bins - j[:-1]) / n_bins
    p = np.zeros(n_bins + 1)
    p[0] = 1.0
    for _ in range(n_balls):
        q = p * stay
        q[1:] += p[:-1] * grow
        if np.abs(q - p).max() < 1e-15 and q[-1] > 0.5:
            break
        p = q
    return float(min(1.0, p[observed:].sum()))


def occupancy_log(n_bins: int, n_balls: int, filled: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities that exactly so many bins are filled.

    The ways to throw k balls into j bins so that each has one are k! times the coefficient of z**k in
    (exp(z) - 1)**j. It is the mean of that function over a circle through its saddle point, where it is
    largest and falls off like a normal density, so equal steps over the circle give all digits."""
    lgamma = np.vectorize(math.lgamma, otypes=[np.float64])
    k, j = float(n_balls), filled.astype(np.float64)
    choose = math.lgamma(n_bins + 1) - lgamma(n_bins - j + 1) - k * math.log(n_bins)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = k / j
        r = np.where(c < 2, 2 * (c - 1), c)
        for _ in range(60):  # Newton's method for r / (1 - exp(-r)) = c
            e = -np.expm1(-r)
            r = np.maximum(r - (r / e - c) / ((e - r * np.exp(-r)) / (e * e)), r / 4)
        # Variance of a ball count that is at least one, and the width of the peak.
        s = 1 / np.sqrt(np.maximum(j * c * (1 + r - c), 1e-300))
        wide = s > 0.05
        t = np.where(wide[:, None], np.pi * (np.arange(256) / 128 - 1), (s * 9)[:, None] * (np.arange(256) / 128 - 1))
        step = np.where(wide, np.pi / 128, s * 9 / 128)
        z = r[:, None] * np.exp(1j * t)
        # log(exp(z) - 1) without large powers, whatever the sign of z's real part.
        right = z.real >= 0
        log_z = np.where(right, z + np.log(-np.expm1(np.where(right, -z, -1))), np.log(np.expm1(np.where(right, -1, z))))
        log_expm1 = r + np.log(-np.expm1(-r))
        f = j[:, None] * (log_z - log_expm1[:, None]) - 1j * k * t
        mean = (np.exp(f).real.sum(axis=1) * step) / (2 * np.pi)
        ways = math.lgamma(k + 1) - lgamma(j + 1) - k * np.log(r) + j * log_expm1 + np.log(mean)
    return choose + np.where(filled == n_balls, 0.0, ways)


def _tail_by_integrals(n_bins: int, n_balls: int, observed: int, chunk: int = 128) -> float:
    mean = -n_bins * math.expm1(n_balls * math.log1p(-1 / n_bins)) if n_bins > 1 else 1.0
    most = min(n_bins, n_balls)
    up = observed > mean
    total, at = 0.0, observed if up else observed - 1
    while 1 <= at <= most:
        js = np.arange(at, min(at + chunk, most + 1)) if up else np.arange(at, max(at - chunk, 0), -1)
        terms = np.exp(occupancy_log(n_bins, n_balls, js))
        total += float(terms.sum())
        # Beyond the mode the terms fall faster and faster.
        if terms[-1] <= 1e-18 * total or total == 0.0 and terms[-1] == 0.0:
            break
        at = int(js[-1]) + (1 if up else -1)
    return float(min(1.0, max(0.0, total if up else 1.0 - total)))

"""Peak picking in profile spectra by ridges of a continuous wavelet transform.

The one operator whose semantics no relational form has: a numpy kernel per spectrum, fed with
packed spectra in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PEAKS, PIXEL, ExperimentParams, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, kept_per_pixel, numbers, one_row, register


@dataclass(frozen=True)
class CwtParams:
    width_min_ppm: float = 20.0
    width_max_ppm: float = 120.0
    n_widths: int = 8
    grid_ppm_step: float = 5.0
    min_snr: float = 3.0
    noise_perc: float = 10.0


def ricker(width: float, most: int) -> np.ndarray:
    """The second derivative of a Gaussian over ten widths, ``most`` points at most."""
    points = min(10 * width, most)
    x = np.arange(0, points) - (points - 1) / 2
    z = (x / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - z) * np.exp(-z / 2)


def transform(y: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """One row a width. Sums are direct: where the spectrum is zero the rows are, which a Fourier transform would miss."""
    out = np.empty((len(widths), len(y)))
    for k, w in enumerate(widths):
        kernel = ricker(float(w), len(y))[::-1]
        out[k] = np.convolve(y, kernel)[(len(kernel) - 1) // 2 :][: len(y)]
    return out


def row_maxima(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero((row[1:-1] > row[:-2]) & (row[1:-1] > row[2:])) + 1


def nearest_lines(cols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, distance) of the line whose last place is nearest to each column; of equal ones that of the lower number."""
    by = np.argsort(last, kind="stable")
    at = last[by]
    # The first of equal places stands for them, as numbers ascend among them.
    places, first = np.unique(at, return_index=True)
    k = np.searchsorted(places, cols, "right")
    left, right = np.maximum(k - 1, 0), np.minimum(k, len(places) - 1)
    dl, dr = np.abs(cols - places[left]), np.abs(cols - places[right])
    ll, lr = by[first[left]], by[first[right]]
    take_right = (dr < dl) | ((dr == dl) & (lr < ll))
    return np.where(take_right, lr, ll), np.minimum(dl, dr)


def ridges(cwt: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, place, length) of the ends of all chains of maxima, from wide to narrow scales.

    A maximum goes on with the chain that was last nearest to it, within a quarter of the scale's width; several can
    go on with one. A chain ends after more scales without a maximum than the least width."""
    rows = [row_maxima(r) for r in cwt]
    top = max((k for k, r in enumerate(rows) if len(r)), default=-1)
    if top < 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap_most = math.ceil(widths[0])
    last = rows[top].copy()
    scale, length, gap = np.full(len(last), top), np.ones(len(last), np.int64), np.zeros(len(last), np.int64)
    done: list[tuple[np.ndarray, ...]] = []
    for k in range(top - 1, -1, -1):
        cols = rows[k]
        gap = gap + 1
        goes_on = np.zeros(len(cols), bool)
        if len(last) and len(cols):
            line, apart = nearest_lines(cols, last)
            goes_on = apart <= widths[k] / 4
            line, place = line[goes_on], cols[goes_on]
            np.add.at(length, line, 1)
            last[line] = place  # ascending: of several the last counts
            scale[line] = k
            gap[line] = 0
        new = cols[~goes_on]
        last, scale, length, gap = (np.concatenate(x) for x in ((last, new), (scale, np.full(len(new), k)), (length, np.ones(len(new), np.int64)), (gap, np.zeros(len(new), np.int64))))
        ended = gap > gap_most
        done.append((scale[ended], last[ended], length[ended]))
        last, scale, length, gap = last[~ended], scale[~ended], length[~ended], gap[~ended]
    done.append((scale, last, length))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def places(y: np.ndarray, widths: np.ndarray, min_snr: float, noise_perc: float) -> np.ndarray:
    """Where the peaks of a spectrum are: ends of chains over a quarter of the scales whose height exceeds the noise, a
    percentile of the narrowest scale around them, by ``min_snr``."""
    c = transform(y, widths)
    scale, at, length = ridges(c, widths)
    long = length >= math.ceil(len(widths) / 4)
    scale, at = scale[long], at[long]
    half, odd = divmod(math.ceil(len(y) / 20), 2)
    noise = np.array([np.percentile(c[0][max(k - half, 0) : min(k + half + odd, len(y))], noise_perc) for k in at])
    with np.errstate(divide="ignore", invalid="ignore"):
        weak = np.abs(c[scale, at] / noise) < min_snr if len(at) else np.zeros(0, bool)
    return np.sort(at[~weak])


def grid_of(lo: float, hi: float, p: CwtParams) -> tuple[np.ndarray, np.ndarray]:
    """(m/z of the grid, widths in its steps)."""
    step = math.log1p(p.grid_ppm_step * 1e-6)
    widths = np.linspace(math.log1p(p.width_min_ppm * 1e-6) / step, math.log1p(p.width_max_ppm * 1e-6) / step, p.n_widths)
    return np.exp(np.arange(math.log(lo), math.log(hi) + step, step)), np.maximum(widths, 1.0)


def pick(mz: np.ndarray, intensity: np.ndarray, grid: np.ndarray, widths: np.ndarray, p: CwtParams) -> tuple[np.ndarray, np.ndarray]:
    """(m/z, height) of the peaks of one spectrum, ascending: the centroid and maximum around each place."""
    if not len(mz):
        return np.zeros(0), np.zeros(0)
    y = np.interp(grid, mz, intensity, left=0.0, right=0.0)
    at = places(y, widths, p.min_snr, p.noise_perc)
    r = int(max(1, np.round(widths.mean())))
    lo, hi = np.maximum(at - r, 0), np.minimum(at + r + 1, len(y))
    centre, height = np.empty(len(at)), np.empty(len(at))
    for k, (i, a, b) in enumerate(zip(at, lo, hi, strict=True)):
        total = y[a:b].sum()
        centre[k] = (grid[a:b] * y[a:b]).sum() / total if total > 0 else grid[i]
        height[k] = y[a:b].max()
    by = np.argsort(centre, kind="stable")
    return centre[by], height[by]


def packed(peaks: DataFrame) -> DataFrame:
    """(dataset_id, pixel_id, mz, intensity) with ascending arrays; one row a spectrum."""
    s = peaks.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct(F.col("mz"), F.col("intensity").cast("double").alias("i")))).alias("s"))
    return s.select(*PIXEL, F.transform("s", lambda v: v["mz"]).alias("mz"), F.transform("s", lambda v: v["i"]).alias("intensity"))


def cwt_pick(spectra: DataFrame, lo: float, hi: float, p: CwtParams) -> DataFrame:
    """Peaks of packed spectra on the grid from ``lo`` to ``hi``; one batch of peaks for a batch of spectra."""
    names = ["dataset_id", "pixel_id", "peak_idx", "mz", "intensity"]

    def run(batches):
        grid, widths = grid_of(lo, hi, p)
        for batch in batches:
            found = [pick(m.values.to_numpy(), i.values.to_numpy(), grid, widths, p) for m, i in zip(batch.column("mz"), batch.column("intensity"), strict=True)]
            n = np.array([len(m) for m, _ in found], np.int64)
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            cols = [batch.column("dataset_id").take(rows), batch.column("pixel_id").take(rows), pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), *(pa.array(np.concatenate([x[k] for x in found] or [np.zeros(0)])) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return spectra.select(*PIXEL, "mz", "intensity").mapInArrow(run, PEAKS)


@register
class CwtPeakPick(Operator):
    name = "cwt_peak_pick"
    params_cls = CwtParams

    def default_params(self, ep: ExperimentParams) -> CwtParams:
        if ep.instrument_family in ("orbitrap", "fticr"):
            return CwtParams(width_min_ppm=2.0, width_max_ppm=15.0, grid_ppm_step=1.0)
        if ep.instrument_family == "tof_axial":
            return CwtParams(width_min_ppm=100.0, width_max_ppm=600.0, grid_ppm_step=20.0)
        return CwtParams()

    def run(self, ds: MsiDataset, params: CwtParams, seed: int) -> OpResult:
        peaks = ds.need_peaks(self.name)
        lo, hi = peaks.agg(F.min("mz"), F.max("mz")).first()
        if lo is None:
            raise RuntimeError("the dataset has no spectra")
        if not 0 < lo < hi:
            raise RuntimeError(f"m/z from {lo} to {hi} make no grid")
        out = hold(cwt_pick(packed(peaks), lo, hi, params))  # the kernel runs once
        if out.isEmpty():
            raise RuntimeError("no peaks found; lower min_snr or look at the widths")
        grid = len(grid_of(lo, hi, params)[0])
        summary = one_row(out.agg(F.count("*").cast("double").alias("n_peaks_total"), *numbers(grid_size=grid, n_widths=params.n_widths, min_snr=params.min_snr)), ds.pixels.agg(F.count("*").cast("double").alias("n_pixels")), kept_per_pixel(ds.pixels, out))
        return OpResult(ds.with_peaks(out), (Diagnostic(self.name, summary, {}, "histogram:peaks_per_pixel"),))

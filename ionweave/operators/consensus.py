"""Alignment to shared channels at the maxima of a weighted density of log m/z."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import assign, numbered
from ..model import DATASET, PIXEL, ExperimentParams, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, prevalences, register
from .tolerance import evaluate

#: The kernel ends at so many bandwidths.
CUTOFF = 5.0


@dataclass(frozen=True)
class KdeParams:
    n_grid_points: int = 32768
    bandwidth_ppm: float = 50.0
    bandwidth_scale: float = 1.0
    min_prominence_quantile: float = 0.5
    default_tol_ppm: float = 50.0
    min_prevalence: float = 0.05

    @property
    def bandwidth(self) -> float:
        return max(self.bandwidth_ppm * self.bandwidth_scale * 1e-6, 1e-12)


def terms(reach: float) -> int:
    """Terms of the expansion that leave an error below 1e-12 of a kernel's height for offsets up to ``reach``
    bandwidths: by Cramer's bound the k-th is at most 1.09 * reach**k / sqrt(k!)."""
    k, term = 0, 1.09
    while term > 1e-13:
        k += 1
        term *= reach / k**0.5
    return k


def density(peaks: DataFrame, p: KdeParams) -> DataFrame:
    """(dataset_id, g, x, density) on a uniform grid of log m/z, all of its points.

    Peaks whose kernels cover the same grid points are summed up by the moments of their offsets from the
    middle of these points: exp(-(u - d)**2 / 2) is exp(-u**2 / 2) times the sum of He_k(u) d**k / k! over
    Hermite's polynomials, and offsets d are half a grid step at most. So there are no more rows to spread
    over the grid than twice its points, whatever the number of peaks, and sums are combined before the shuffle.
    """
    bw, last = p.bandwidth, p.n_grid_points - 1
    pad = CUTOFF * bw
    ln = F.log("mz")
    span = peaks.groupBy("dataset_id").agg((F.min(ln) - pad).alias("lo"), (F.max(ln) + pad).alias("hi"), F.sum(F.col("intensity").cast("double")).alias("total"))
    span = hold(span.withColumn("h", (F.col("hi") - F.col("lo")) / last))
    w = peaks.select("dataset_id", ln.alias("x"), F.col("intensity").cast("double").alias("w")).join(span.select("dataset_id", "lo", "h"), DATASET)
    first, upto = F.ceil((F.col("x") - pad - F.col("lo")) / F.col("h")), F.floor((F.col("x") + pad - F.col("lo")) / F.col("h"))
    first, upto = F.greatest(F.lit(0), first), F.least(F.lit(last), upto)
    w = w.select("dataset_id", "x", "w", "lo", "h", first.cast("bigint").alias("a"), upto.cast("bigint").alias("b")).where("a <= b")
    widest = (span.agg(F.max("h")).first()[0] or 0.0) / bw
    if widest <= 4:
        middle = F.col("lo") + (F.col("a") + F.col("b")) / 2 * F.col("h")
        n = terms(max(0.51 * widest, 1e-3))
        d = w.select("dataset_id", "lo", "h", "a", "b", "w", ((F.col("x") - middle) / bw).alias("d"))
        moments = [F.sum(F.col("w") * (F.lit(1.0) if k == 0 else F.pow("d", F.lit(float(k))))) / F.lit(float(math.factorial(k))) for k in range(n)]
        cells = d.groupBy("dataset_id", "lo", "h", "a", "b").agg(F.array(*moments).alias("m"))
        spread = cells.select("dataset_id", "m", ((F.explode(F.sequence("a", "b")))).alias("g"), ((F.col("a") + F.col("b")) / 2).alias("at"), (F.col("h") / bw).alias("step"))
        u = (F.col("g") - F.col("at")) * F.col("step")
        spread = spread.select("dataset_id", "g", "m", u.alias("u"))
        # Clenshaw's sums from the last term: b_k = m_k + u b_(k+1) - (k+1) b_(k+2).
        zero = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(float(n)).alias("k"))
        value = F.aggregate(F.reverse("m"), zero, lambda acc, m: F.struct((m + F.col("u") * acc["y"] - acc["k"] * acc["z"]).alias("y"), acc["y"].alias("z"), (acc["k"] - 1).alias("k")), lambda acc: acc["y"])
        kernel = F.exp(-0.5 * F.col("u") * F.col("u")) * value
    else:  # ten bandwidths are three steps at most: a few grid points a peak
        spread = w.select("dataset_id", "x", "w", "lo", "h", F.explode(F.sequence("a", "b")).alias("g"))
        d = (F.col("lo") + F.col("g") * F.col("h") - F.col("x")) / bw
        kernel = F.col("w") * F.exp(-0.5 * d * d)
    sums = spread.groupBy("dataset_id", "g").agg(F.sum(kernel).alias("s"))
    every = span.select("dataset_id", "lo", "h", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("g"))
    norm = F.lit((2 * 3.141592653589793) ** 0.5 * bw) * F.col("total")
    return every.join(sums, ["dataset_id", "g"], "left").select("dataset_id", "g", (F.col("lo") + F.col("g") * F.col("h")).alias("x"), F.coalesce(F.try_divide("s", norm), F.lit(0.0)).alias("density"))


def maxima(grid: DataFrame, quantile: float) -> DataFrame:
    """(dataset_id, g, mz, density, prominent): all strict local maxima; where no one exceeds the
    quantile of the whole grid, the first of the highest points stands in."""
    by = Window.partitionBy("dataset_id").orderBy("g")  # over grid points, a fixed number a dataset
    y = F.col("density")
    marked = grid.withColumn("is_max", F.coalesce((y > F.lag("density").over(by)) & (y > F.lead("density").over(by)), F.lit(False)))
    marked = marked.withColumn("thr", F.percentile("density", F.lit(quantile)).over(Window.partitionBy("dataset_id")))
    marked = marked.withColumn("prominent", F.col("is_max") & (y > F.col("thr")))
    whole = Window.partitionBy("dataset_id")
    stand_in = (F.max(F.col("prominent").cast("int")).over(whole) == 0) & (F.col("g") == F.min_by("g", F.struct(-y, F.col("g"))).over(whole))
    return marked.withColumn("prominent", F.col("prominent") | stand_in).where("is_max OR prominent").select("dataset_id", "g", F.exp("x").alias("mz"), "density", "prominent")


def windowed(axis: DataFrame, curve: DataFrame | None, default_ppm: float) -> DataFrame:
    """``axis`` with ``lo`` and ``hi``, its tolerance windows."""
    axis = evaluate(curve, axis, "mz", "tol") if curve is not None else axis.withColumn("tol", F.lit(float(default_ppm)))
    t = F.coalesce("tol", F.lit(float(default_ppm))) * 1e-6
    return axis.withColumn("lo", F.col("mz") * (1 - t)).withColumn("hi", F.col("mz") * (1 + t))


def aligned(peaks: DataFrame, axis: DataFrame, n_pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, counts): the strongest peak of each pixel and channel, zeros left out, and
    (dataset_id, channel, mz, prevalence, n_peaks) of every channel of ``axis``."""
    hits = assign(peaks, axis)
    every = hold(hits.groupBy(*PIXEL, "channel").agg(F.max("intensity").alias("intensity"), F.count("*").alias("k")))
    per = every.groupBy("dataset_id", "channel").agg(F.count_if(F.col("intensity") > 0).alias("seen"), F.sum("k").alias("n_peaks"))
    counts = axis.join(per, ["dataset_id", "channel"], "left").join(n_pixels, DATASET)
    counts = counts.select("dataset_id", "channel", "mz", (F.coalesce("seen", F.lit(0)) / F.col("n_pixels")).alias("prevalence"), F.coalesce("n_peaks", F.lit(0)).cast("bigint").alias("n_peaks"))
    return every.where("intensity > 0").drop("k"), hold(counts)


def keep_channels(cells: DataFrame, channels: DataFrame, kept) -> tuple[DataFrame, DataFrame]:
    """Cells and channels of the channels that meet ``kept``, numbered anew by m/z."""
    new = numbered(channels.where(kept).withColumnRenamed("channel", "old"))
    key = new.select("dataset_id", F.col("old").alias("channel"), F.col("channel").alias("new"))
    cells = cells.join(key, ["dataset_id", "channel"]).select(*PIXEL, F.col("new").alias("channel"), "intensity")
    return cells, new.select("dataset_id", "channel", "mz", "prevalence", "n_peaks", *[c for c in new.columns if c not in ("dataset_id", "channel", "mz", "prevalence", "n_peaks", "old")])


def candidates(m: DataFrame) -> DataFrame:
    """(dataset_id, channel, mz, density): the prominent ones of ``maxima``, numbered by m/z."""
    return numbered(m.where("prominent").select("dataset_id", "mz", "density"))


def align_kde(ds: MsiDataset, p: KdeParams) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, channels, candidate channels before the prevalence floor, all maxima of the density)."""
    peaks = ds.need_peaks("kde_consensus_alignment")
    m = hold(maxima(density(peaks, p), p.min_prominence_quantile))
    axis = windowed(candidates(m), ds.extras.get("tolerance_curve"), p.default_tol_ppm)
    cells, counts = aligned(peaks, axis, ds.n_pixels())
    return *keep_channels(cells, counts, F.col("prevalence") >= p.min_prevalence), counts, m


def need_some(channels: DataFrame, what: str) -> None:
    if channels.isEmpty():
        raise RuntimeError(what)


@register
class KdeConsensus(Operator):
    name = "kde_consensus_alignment"
    params_cls = KdeParams

    def default_params(self, ep: ExperimentParams) -> KdeParams:
        ppm = {"orbitrap": 5.0, "fticr": 5.0, "tof_axial": 200.0}.get(ep.instrument_family, 50.0)
        return KdeParams(bandwidth_ppm=ppm, default_tol_ppm=ppm)

    def run(self, ds: MsiDataset, params: KdeParams, seed: int) -> OpResult:
        if ds.need_peaks(self.name).isEmpty():
            raise RuntimeError("the dataset has no peaks to align")
        cells, channels, every, m = align_kde(ds, params)
        need_some(channels, f"no channel reaches min_prevalence={params.min_prevalence}; lower it or look at the peak picking")
        summary = every.agg(
            F.count("*").cast("double").alias("n_post_prominence"), F.count_if(F.col("prevalence") >= params.min_prevalence).cast("double").alias("n_consensus_peaks"),
            F.count_if(F.col("prevalence") < params.min_prevalence).cast("double").alias("n_rejected_by_prevalence"), *numbers(bandwidth_log_mz=params.bandwidth, min_prominence_quantile=params.min_prominence_quantile, min_prevalence_threshold=params.min_prevalence),
        ).crossJoin(prevalences(channels)).crossJoin(m.agg(F.count_if("prominent").cast("double").alias("n_prominent"), F.count_if(~F.col("prominent")).cast("double").alias("n_rejected_by_prominence"), F.count("*").cast("double").alias("n_local_maxima_total")))
        out = ds.with_matrix(cells, channels).with_extras(candidates=every, maxima=m)
        return OpResult(out, (Diagnostic(self.name, summary, {"candidates": every, "maxima": m}, "stem:mz_vs_prevalence"),))

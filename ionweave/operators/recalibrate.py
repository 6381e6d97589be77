"""m/z recalibration by reference ions: a robust piecewise-linear warp, or a single lock mass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import md5_int
from ..model import DATASET, PIXEL, ExperimentParams, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, one_row, register
from .tolerance import evaluate

FLAT_THRESHOLD_PPM = 50.0
STRATEGIES = ("highest_intensity", "highest_prevalence", "closest_to_mz")


@dataclass(frozen=True)
class WarpParams:
    """``rng_seed`` is accepted for old specs; the node's seed decides."""

    ransac_threshold_ppm: float = 0.0
    ransac_n_trials: int = 64
    min_inliers: int = 3
    rng_seed: int = 0


@dataclass(frozen=True)
class LockMassParams:
    anchor_strategy: str = "highest_intensity"
    explicit_anchor_mz: float = 0.0
    max_shift_ppm: float = 500.0

    def __post_init__(self) -> None:
        if self.anchor_strategy not in STRATEGIES:
            raise ValueError(f"unknown anchor strategy {self.anchor_strategy!r}")
        if self.anchor_strategy == "closest_to_mz" and not self.explicit_anchor_mz > 0:
            raise ValueError("closest_to_mz needs explicit_anchor_mz above 0")


def anchors(ref_ions: DataFrame, ref_obs: DataFrame, curve: DataFrame | None, p: WarpParams) -> DataFrame:
    """(dataset_id, pixel_id, n, a): each pixel's visible anchors by reference, as an array of
    (ref_id, ref, obs, thr). As long as the list of reference ions, at most."""
    refs = ref_ions.select("dataset_id", "ref_id", F.col("mz").alias("ref"))
    if p.ransac_threshold_ppm > 0:
        refs = refs.withColumn("thr", F.lit(float(p.ransac_threshold_ppm)))
    elif curve is not None:
        refs = evaluate(curve, refs, "ref", "tol").withColumn("thr", 2 * F.col("tol")).drop("tol")
    else:
        refs = refs.withColumn("thr", F.lit(FLAT_THRESHOLD_PPM))
    seen = ref_obs.select(*PIXEL, "ref_id", F.col("mz").alias("obs")).join(refs, ["dataset_id", "ref_id"])
    a = seen.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("ref_id", "ref", "obs", "thr"))).alias("a"))
    return a.withColumn("n", F.size("a"))


def best_line(a: DataFrame, p: WarpParams, seed: int) -> DataFrame:
    """``a`` with (slope, icpt) of the pair of anchors whose line has most inliers, then the least sum of
    squares, then comes first. All pairs are tried if no more than ``ransac_n_trials``; else as many
    pairs are drawn by hashes of (seed, pixel, trial), repeats included.

    The trials of a pixel are one small matrix: nothing is exploded or shuffled."""
    n, pairs = F.col("n"), (F.col("n") * (F.col("n") - 1) / 2).cast("int")
    trials = F.sequence(F.lit(0), F.least(pairs, F.lit(p.ransac_n_trials)) - 1)
    every = pairs <= p.ransac_n_trials
    # The t-th pair of i < j in order: i is the largest with i * (2n - i - 1) / 2 <= t.
    before = lambda i: i * (2 * n - i - 1) / 2
    i_all = lambda t: F.size(F.filter(F.sequence(F.lit(0), n - 2), lambda i: before(i) <= t)) - 1
    x = lambda t: F.pmod(md5_int(seed, F.col("pixel_id"), t, "a"), n)
    y = lambda t: F.pmod(md5_int(seed, F.col("pixel_id"), t, "b"), n - 1)
    t = a.where((n >= p.min_inliers) & (n >= 2)).select(
        *PIXEL, "a", F.when(every, F.transform(trials, lambda t: i_all(t).cast("bigint"))).otherwise(F.transform(trials, x)).alias("i"),
        F.when(every, F.transform(trials, lambda t: (t - before(i_all(t)) + i_all(t) + 1).cast("bigint"))).otherwise(F.transform(trials, y)).alias("j"), every.alias("every"),
    )

    def run(batches):
        for batch in batches:
            anchors, i_of, j_of = (batch.column(c) for c in ("a", "i", "j"))
            ref, obs, thr = (anchors.flatten().field(c).to_numpy() for c in ("ref", "obs", "thr"))
            at = anchors.offsets.to_numpy() - anchors.offsets[0].as_py()
            found = [line(ref[b:e], obs[b:e], thr[b:e], i.values.to_numpy(), j.values.to_numpy(), e_) for b, e, i, j, e_ in zip(at[:-1], at[1:], i_of, j_of, batch.column("every").to_pylist(), strict=True)]
            cols = [pa.array([f and f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PIXEL, "a")), *cols], [*PIXEL, "a", "slope", "icpt"])

    kept = [f for f in t.schema if f.name in (*PIXEL, "a")]
    out = t.mapInArrow(run, T.StructType([*kept, T.StructField("slope", T.DoubleType()), T.StructField("icpt", T.DoubleType())]))
    return out.where("slope IS NOT NULL")


def line(ref: np.ndarray, obs: np.ndarray, thr: np.ndarray, i: np.ndarray, j: np.ndarray, every: bool) -> tuple[float, float] | None:
    """(slope, intercept) of the best of the lines through the anchors ``i`` and ``j``."""
    if not every:  # drawn: two different ones, the lower first
        j = np.where(j >= i, j + 1, j)
        i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = i[obs[i] != obs[j]], j[obs[i] != obs[j]]
    if not len(i):
        return None
    slope = (ref[j] - ref[i]) / (obs[j] - obs[i])
    icpt = ref[i] - slope * obs[i]
    r = np.abs((slope[:, None] * obs + icpt[:, None] - ref) / ref) * 1e6
    fits = r <= thr
    count, sse = fits.sum(axis=1), np.where(fits, r * r, 0.0).sum(axis=1)
    best = np.lexsort((np.arange(len(i)), sse, -count))[0]
    return (float(slope[best]), float(icpt[best])) if count[best] else None


def residual(s: Column) -> Column:
    return F.abs((F.col("slope") * s["obs"] + F.col("icpt") - s["ref"]) / s["ref"]) * 1e6


def warps(a: DataFrame, p: WarpParams, seed: int) -> DataFrame:
    """(dataset_id, pixel_id, obs, ref, n_inliers): ascending inlier anchors of the recalibrated pixels."""
    two = a.where((F.col("n") == 2) & (p.min_inliers <= 2)).select(*PIXEL, F.col("a").alias("inl"))
    more = best_line(a.where("n > 2"), p, seed).select(*PIXEL, F.filter("a", lambda s: residual(s) <= s["thr"]).alias("inl"))
    w = two.unionByName(more).where(F.size("inl") >= p.min_inliers)
    w = w.withColumn("inl", F.array_sort(F.transform("inl", lambda s: F.struct(s["obs"].alias("obs"), s["ref"].alias("ref")))))
    return w.select(*PIXEL, F.transform("inl", lambda s: s["obs"]).alias("obs"), F.transform("inl", lambda s: s["ref"]).alias("ref"), F.size("inl").alias("n_inliers"))


def pieces(w: DataFrame) -> DataFrame:
    """(dataset_id, pixel_id, mz, piece): the linear pieces of each warp from where they begin: inside the
    anchors between two of them, outside with the offset of the end."""
    n = F.size("obs")
    at = lambda c, k: F.get(c, k)
    one = lambda start, k, slope: F.struct(start.alias("mz"), at("obs", k).alias("x"), at("ref", k).alias("y"), slope.alias("slope"))
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda k: one(at("obs", k), k, F.when(k == n - 1, 1.0).otherwise(F.coalesce(F.try_divide(at("ref", k + 1) - at("ref", k), at("obs", k + 1) - at("obs", k)), F.lit(1.0)))))
    first = F.array(one(F.lit(float("-inf")), F.lit(0), F.lit(1.0)))
    p = w.select(*PIXEL, F.explode(F.concat(first, inner)).alias("p"))
    return p.select(*PIXEL, "p.mz", F.struct("p.x", "p.y", "p.slope").alias("piece"))


def warped(peaks: DataFrame, w: DataFrame) -> DataFrame:
    """``peaks`` with their m/z moved by their pixel's warp, where it has one: peaks and pieces are sorted
    together by pixel and m/z, and each peak takes the last piece before it."""
    none = pieces(w).schema["piece"].dataType
    both = peaks.withColumn("piece", F.lit(None).cast(none)).withColumn("_peak", F.lit(True)).unionByName(pieces(w).withColumn("_peak", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy(*PIXEL).orderBy("mz", "_peak").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("_p")
    moved = both.withColumn("_p", F.last("piece", ignorenulls=True).over(by)).where("_peak")
    return moved.withColumn("mz", F.coalesce(p["y"] + (F.col("mz") - p["x"]) * p["slope"], F.col("mz"))).select(*peaks.columns)


@register
class MsiwarpRecalibrate(Operator):
    name = "msiwarp_recalibrate"
    params_cls = WarpParams

    def validate(self, ep: ExperimentParams) -> list[str]:
        if ep.instrument_family in ("orbitrap", "fticr"):
            return ["High-resolution analysers rarely need recalibration; leave it out or use a threshold below 1 ppm."]
        return []

    def run(self, ds: MsiDataset, params: WarpParams, seed: int) -> OpResult:
        peaks = ds.need_peaks(self.name)
        if "ref_ions" not in ds.extras:
            raise RuntimeError(f"{self.name} needs reference ions; detect them first")
        w = hold(warps(anchors(ds.extras["ref_ions"], ds.extras["ref_obs"], ds.extras.get("tolerance_curve"), params), params, seed))
        summary = ds.pixels.select(*PIXEL).join(w, PIXEL, "left").agg(
            F.count("n_inliers").cast("double").alias("n_pixels_recalibrated"), F.count_if(F.col("n_inliers").isNull()).cast("double").alias("n_pixels_skipped"),
            F.avg(F.col("n_inliers").isNotNull().cast("double")).alias("fraction_pixels_recalibrated"), F.coalesce(F.median("n_inliers"), F.lit(0.0)).alias("inliers_median"),
            F.coalesce(F.min("n_inliers"), F.lit(0)).cast("double").alias("inliers_min"),
        )
        summary = one_row(summary, residuals(ds.extras["ref_ions"], ds.extras["ref_obs"], w))
        return OpResult(ds.with_peaks(warped(peaks, w)), (Diagnostic(self.name, summary, {}, "histogram:residuals"),))


def residuals(ref_ions: DataFrame, ref_obs: DataFrame, w: DataFrame) -> DataFrame:
    """One row: the median error of all anchors before, that of recalibrated pixels' anchors after, and the difference."""
    before = ref_obs.agg(F.median(F.abs("ppm_error")).alias("pre_residual_median_ppm"))
    moved = warped(ref_obs.select(*PIXEL, "ref_id", "mz").join(w.select(*PIXEL), PIXEL, "left_semi"), w).join(ref_ions.select("dataset_id", "ref_id", F.col("mz").alias("ref")), ["dataset_id", "ref_id"])
    after = moved.agg(F.median(F.abs((F.col("mz") - F.col("ref")) / F.col("ref") * 1e6)).alias("post_residual_median_ppm"))
    return one_row(before, after).withColumn("improvement_ppm", F.coalesce(F.col("pre_residual_median_ppm") - F.col("post_residual_median_ppm"), F.lit(0.0)))


def lock_factors(ref_ions: DataFrame, ref_obs: DataFrame, p: LockMassParams) -> DataFrame:
    """(dataset_id, pixel_id, factor): observed over reference m/z of each pixel's one anchor."""
    seen = ref_obs.select(*PIXEL, "ref_id", F.col("mz").alias("obs"), "intensity").join(ref_ions.select("dataset_id", "ref_id", F.col("mz").alias("ref"), "prevalence"), ["dataset_id", "ref_id"])
    order = {"highest_intensity": -F.col("intensity"), "highest_prevalence": -F.col("prevalence"), "closest_to_mz": F.abs(F.col("ref") - F.lit(float(p.explicit_anchor_mz)))}[p.anchor_strategy]
    one = seen.groupBy(*PIXEL).agg(F.min(F.struct(order.alias("o"), "ref_id", "obs", "ref")).alias("s")).select(*PIXEL, "s.obs", "s.ref")
    return one.where(F.abs(F.col("obs") - F.col("ref")) / F.col("ref") * 1e6 <= p.max_shift_ppm).select(*PIXEL, (F.col("obs") / F.col("ref")).alias("factor"))


@register
class LockMassRecalibrate(Operator):
    name = "lock_mass_recalibrate"
    params_cls = LockMassParams

    def run(self, ds: MsiDataset, params: LockMassParams, seed: int) -> OpResult:
        peaks = ds.need_peaks(self.name)
        if "ref_ions" not in ds.extras:
            raise RuntimeError(f"{self.name} needs reference ions; detect them first")
        f = lock_factors(ds.extras["ref_ions"], ds.extras["ref_obs"], params)
        out = peaks.join(f, PIXEL, "left").withColumn("mz", F.col("mz") / F.coalesce("factor", F.lit(1.0))).drop("factor")
        shift = (F.col("factor") - 1) * 1e6
        summary = ds.pixels.select(*PIXEL).join(f, PIXEL, "left").agg(
            F.count("factor").cast("double").alias("n_pixels_recalibrated"), F.count_if(F.col("factor").isNull()).cast("double").alias("n_pixels_skipped"), F.avg(F.col("factor").isNotNull().cast("double")).alias("fraction_pixels_recalibrated"),
            *(F.coalesce(x, F.lit(0.0)).alias(k) for k, x in (("ppm_shift_median", F.median(shift)), ("ppm_shift_abs_median", F.median(F.abs(shift))), ("ppm_shift_abs_max", F.max(F.abs(shift))))), *numbers(anchor_strategy_index=STRATEGIES.index(params.anchor_strategy)),
        )
        return OpResult(ds.with_peaks(out), (Diagnostic(self.name, summary, {}, "histogram:shift"),))

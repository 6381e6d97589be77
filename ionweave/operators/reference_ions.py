"""Ions that most pixels show: the anchors of tolerance, recalibration and normalisation."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import log_bin, ppm_error, weighted_mean
from ..model import DATASET, PIXEL, ExperimentParams, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, one_row, prevalences, register


@dataclass(frozen=True)
class ReferenceIonParams:
    coarse_tol_ppm: float = 50.0
    min_prevalence: float = 0.8
    min_count: int = 5
    merge_adjacent_bins: bool = True


def best_of_bins(peaks: DataFrame, ppm: float) -> DataFrame:
    """The strongest peak of each pixel and bin; ties go to the earliest peak, then the lowest m/z.

    The largest intensities come from a hash aggregation of numbers; only peaks that have them are compared further,
    as the largest of a struct would sort all peaks."""
    b = peaks.select(*PIXEL, log_bin("mz", ppm).alias("bin"), F.col("intensity").cast("double").alias("intensity"), "peak_idx", "mz")
    top = hold(b.groupBy(*PIXEL, "bin").agg(F.max("intensity").alias("most")))
    same = [b[c].eqNullSafe(top[c]) for c in (*PIXEL, "bin")] + [b["intensity"].eqNullSafe(top["most"])]
    tied = b.join(top, functools.reduce(Column.__and__, same)).select(b["*"])
    first = F.max(F.struct((-F.col("peak_idx")).alias("k"), (-F.col("mz")).alias("m")))
    got = tied.groupBy(*PIXEL, "bin").agg(first.alias("t"), F.max("intensity").alias("i"))
    return got.select(*PIXEL, "bin", (-F.col("t.k")).alias("peak_idx"), (-F.col("t.m")).alias("mz"), F.col("i").alias("intensity"))


def kept_bins(best: DataFrame, n_pixels: DataFrame, p: ReferenceIonParams) -> DataFrame:
    """(dataset_id, bin, grp): prevalent bins, adjacent ones in one group."""
    n = best.groupBy("dataset_id", "bin").agg(F.count("*").alias("n"))
    kept = n.join(n_pixels, DATASET).where((F.col("n") / F.col("n_pixels") >= p.min_prevalence) & (F.col("n") >= p.min_count))
    # Islands: along a run of adjacent bins, bin minus rank is constant. The window is over bins.
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("bin"))
    return kept.select("dataset_id", "bin", (F.col("bin") - rank if p.merge_adjacent_bins else F.col("bin")).alias("grp"))


def reference_ions(peaks: DataFrame, n_pixels: DataFrame, p: ReferenceIonParams) -> tuple[DataFrame, DataFrame]:
    """(ref_ions, ref_obs): ``ref_ions(dataset_id, ref_id, mz, prevalence, n_obs)`` by ascending m/z and
    ``ref_obs(dataset_id, pixel_id, ref_id, mz, intensity, ppm_error)``."""
    best = hold(best_of_bins(peaks, p.coarse_tol_ppm))
    bins = kept_bins(best, n_pixels, p)
    # Both results are made of the written observations: the peaks are read once.
    obs = hold(best.join(bins, ["dataset_id", "bin"]).groupBy(*PIXEL, "grp").agg(weighted_mean("mz", "intensity").alias("mz"), F.sum("intensity").alias("intensity")))
    positive = F.col("intensity") > 0
    refs = obs.groupBy("dataset_id", "grp").agg(
        F.coalesce(F.try_divide(F.sum(F.when(positive, F.col("mz") * F.col("intensity"))), F.sum(F.when(positive, F.col("intensity")))), F.avg("mz")).alias("mz"),
        F.count_if(positive).alias("n_obs"),
    )
    refs = refs.join(n_pixels, DATASET).withColumn("prevalence", F.col("n_obs") / F.col("n_pixels"))
    refs = refs.withColumn("ref_id", (F.row_number().over(Window.partitionBy("dataset_id").orderBy("mz", "grp")) - 1).cast("int"))
    key = refs.select("dataset_id", "grp", "ref_id", F.col("mz").alias("ref_mz"))
    seen = obs.where(positive).join(key, ["dataset_id", "grp"])
    return refs.select("dataset_id", "ref_id", "mz", "prevalence", "n_obs"), seen.select(*PIXEL, "ref_id", "mz", "intensity", ppm_error("mz", "ref_mz").alias("ppm_error"))


@register
class DetectReferenceIons(Operator):
    name = "detect_reference_ions"
    params_cls = ReferenceIonParams

    def default_params(self, ep: ExperimentParams) -> ReferenceIonParams:
        ppm = {"orbitrap": 5.0, "fticr": 5.0, "tof_axial": 200.0}.get(ep.instrument_family, 50.0)
        return ReferenceIonParams(coarse_tol_ppm=ppm, min_prevalence=0.7 if ep.profile_or_centroided == "profile" else 0.8)

    def run(self, ds: MsiDataset, params: ReferenceIonParams, seed: int) -> OpResult:
        refs, obs = map(hold, reference_ions(ds.need_peaks(self.name), ds.n_pixels(), params))
        summary = one_row(refs.agg(F.count("*").cast("double").alias("n_reference_ions"), *numbers(coarse_tol_ppm=params.coarse_tol_ppm, min_prevalence=params.min_prevalence)), prevalences(refs), ds.pixels.agg(F.count("*").cast("double").alias("n_pixels")))
        return OpResult(ds.with_extras(ref_ions=refs, ref_obs=obs), (Diagnostic(self.name, summary, {"ref_ions": refs}, "stem:mz_vs_prevalence"),))

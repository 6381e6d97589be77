"""Alignment of a cohort to one shared axis: the single-dataset operators, with ``dataset_id`` in every key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import numbered
from ..model import PEAKS, PIXELS, MsiDataset, hold
from ..operators.base import one_row
from ..operators.consensus import KdeParams, aligned, density, maxima, need_some, windowed
from ..operators.normalize import scaled, with_factor
from ..operators.pick import SnrParams, with_threshold
from ..operators.recalibrate import WarpParams, anchors, warped, warps
from ..operators.reference_ions import ReferenceIonParams, reference_ions
from ..operators.tolerance import ToleranceParams, tolerance_curve


@dataclass(frozen=True)
class CohortParams:
    """``min_prevalence`` filters only with ``apply_min_prevalence``."""

    bandwidth_ppm: float = 50.0
    bandwidth_scale: float = 1.0
    n_grid_points: int = 32768
    min_prominence_quantile: float = 0.5
    default_tol_ppm: float = 50.0
    min_prevalence: float = 0.05
    apply_min_prevalence: bool = False
    recalibrate: bool = True
    pool_normalize: bool = True
    snr_mad: float = 3.0
    bootstrap_B: int = 200
    reference: ReferenceIonParams = ReferenceIonParams()


@dataclass(frozen=True)
class CohortResult:
    dataset: MsiDataset
    axis: DataFrame
    prevalence: DataFrame
    per_dataset: DataFrame
    #: One row of counts and prevalences, computed when asked for.
    diagnostics: DataFrame
    params: CohortParams


def union(datasets: list[MsiDataset]) -> MsiDataset:
    """One dataset of several; their ids must differ."""
    first, rest = datasets[0], datasets[1:]
    pixels, peaks = first.pixels, first.need_peaks("align_cohort")
    for d in rest:
        pixels, peaks = pixels.unionByName(d.pixels), peaks.unionByName(d.need_peaks("align_cohort"))
    h, w = max(d.grid_shape[0] for d in datasets), max(d.grid_shape[1] for d in datasets)
    return first.with_(pixels=pixels, peaks=peaks, grid_shape=(h, w))


def prepared(ds: MsiDataset, p: CohortParams, seed: int) -> tuple[DataFrame, DataFrame]:
    """(peaks, tolerance curves): every dataset on its own, in one plan."""
    peaks, n = ds.need_peaks("align_cohort"), ds.n_pixels()
    refs, obs = map(hold, reference_ions(peaks, n, p.reference))
    curve = hold(tolerance_curve(refs, obs, ds.pixels, ToleranceParams(bootstrap_B=p.bootstrap_B, block_bootstrap=False), seed))
    if p.recalibrate and ds.metadata.instrument_family in ("tof_axial", "tof_reflectron", "qtof"):
        wp = WarpParams()
        peaks = warped(peaks, warps(anchors(refs, obs, curve, wp), wp, seed))
    if p.pool_normalize:
        peaks = scaled(with_factor(peaks, "median", 1e-12))
    if ds.metadata.profile_or_centroided != "profile":
        peaks = with_threshold(peaks, SnrParams(snr_mad=p.snr_mad)).where("intensity > threshold").drop("threshold")
    return hold(peaks), curve


def align_cohort(ds: MsiDataset, p: CohortParams | None = None, seed: int = 0) -> CohortResult:
    """Shared channels of all datasets of ``ds``; cells keep their dataset."""
    p = p or CohortParams()
    return align_prepared(ds, *prepared(ds, p, seed), p)


def align_prepared(ds: MsiDataset, peaks: DataFrame, curve: DataFrame, p: CohortParams) -> CohortResult:
    """As :func:`align_cohort`, for the ``peaks`` and tolerance curves that :func:`prepared` made."""
    kde = KdeParams(p.n_grid_points, p.bandwidth_ppm, p.bandwidth_scale, p.min_prominence_quantile, p.default_tol_ppm)
    pooled = peaks.withColumn("dataset_id", F.lit("cohort"))
    shared = hold(numbered(maxima(density(pooled, kde), p.min_prominence_quantile).where("prominent").select("dataset_id", "mz")))
    axis = shared.select("channel", "mz")
    mine = windowed(ds.n_pixels().select("dataset_id").crossJoin(axis), curve, p.default_tol_ppm)  # datasets x channels
    cells, per = aligned(peaks, mine, ds.n_pixels())
    # Carriers of a channel over all pixels of the cohort: those of the datasets together.
    n = ds.n_pixels()
    total = n.agg(F.sum("n_pixels").alias("total"))
    carriers = cells.groupBy("channel").agg(F.count("*").alias("k"))
    prevalence = axis.join(carriers, "channel", "left").crossJoin(total).select("channel", "mz", (F.coalesce("k", F.lit(0)) / F.col("total")).alias("prevalence"))
    candidates = axis
    if p.apply_min_prevalence:
        kept = prevalence.where(F.col("prevalence") >= p.min_prevalence).select("channel")
        axis, prevalence, cells, per = (x.join(kept, "channel", "left_semi") for x in (axis, prevalence, cells, per))
    diagnostics = one_row(
        n.agg(F.count("*").cast("double").alias("n_datasets"), F.sum("n_pixels").cast("double").alias("n_total_pixels")), peaks.agg(F.count("*").cast("double").alias("n_total_peaks_pooled")), candidates.agg(F.count("*").cast("double").alias("n_consensus_candidates_pre_filter")),
        prevalence.agg(F.count("*").cast("double").alias("n_consensus_shared"), F.min("prevalence").alias("cohort_prevalence_min"), F.median("prevalence").alias("cohort_prevalence_median"), F.max("prevalence").alias("cohort_prevalence_max")),
    )
    return CohortResult(ds.with_matrix(cells, per), axis, prevalence, per, diagnostics, p)


class GrowingCohort:
    """A cohort in a folder, to which datasets are added as they are acquired.

    What a dataset goes through on its own, from anchors to picked peaks, is done once, when it's added, and
    kept by dataset; draws are keyed by pixels, so that it doesn't matter what else is added with it. The axis is
    found anew from all kept peaks, in one pass over them, so the result is that of a full run. A dataset
    that is added again takes the place of its old one."""

    def __init__(self, spark: SparkSession, folder: str, params: CohortParams | None = None, seed: int = 0) -> None:
        self.spark, self.folder, self.params, self.seed = spark, folder.rstrip("/"), params or CohortParams(), seed

    def add(self, ds: MsiDataset) -> None:
        """Prepare and keep the datasets of ``ds``. Pixels are written last: a dataset without them isn't there."""
        peaks, curve = prepared(ds, self.params, self.seed)
        about = ds.pixels.select("dataset_id").distinct().select("dataset_id", F.lit(ds.grid_shape[0]).alias("height"), F.lit(ds.grid_shape[1]).alias("width"))
        for name, df in (("peaks", peaks), ("curves", curve), ("about", about), ("pixels", ds.pixels)):
            df.hint("rebalance", "dataset_id").write.partitionBy("dataset_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def align(self) -> CohortResult:
        pixels = self._table("pixels", PIXELS)
        here = pixels.select("dataset_id").distinct()
        peaks = self._table("peaks", PEAKS).join(here, "dataset_id", "left_semi")
        curve = self._table("curves", "dataset_id string, i int, mz_grid double, ppm_quantile double, ci_low double, ci_high double").join(here, "dataset_id", "left_semi")
        h, w = self._table("about", "dataset_id string, height int, width int").agg(F.max("height"), F.max("width")).first()
        return align_prepared(MsiDataset(pixels, peaks=peaks, grid_shape=(h, w)), peaks, curve, self.params)


def check(result: CohortResult) -> None:
    need_some(result.axis, "the cohort shares no channel")


def with_id(ds: MsiDataset, dataset_id: str) -> MsiDataset:
    one = lambda df: df.withColumn("dataset_id", F.lit(dataset_id)) if df is not None else None
    return replace(ds, pixels=one(ds.pixels), peaks=one(ds.peaks), cells=one(ds.cells), channels=one(ds.channels))

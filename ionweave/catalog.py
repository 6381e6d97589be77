"""The registered queries of the imaging engine and their SQL.

Every query runs an operator over a whole table of the test data; doubles are rounded on both
sides, as sums in another order differ in the last digits.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracle as O
from .functions.axis import numbered
from .functions.grid import image
from .model import MsiDataset, hold, shared_dir
from .operators import background, consensus, cwt, dbscan, hot_pixel, moran, normalize, pick, prevalence, recalibrate, reference_ions, tolerance
from .operators.base import operator
from .plans import cohort, diagnostics, pipeline, views
from .sources import files, imzml, tiff
from .testdata import BG, FG, cells_dataset, peaks_dataset, profile_spectra, sparse_peaks

REF = reference_ions.ReferenceIonParams(min_prevalence=0.5)
KDE = consensus.KdeParams()


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def refs(ds: MsiDataset, p=REF) -> tuple[DataFrame, DataFrame]:
    ions, obs = reference_ions.reference_ions(ds.peaks, ds.n_pixels(), p)
    return hold(ions), hold(obs)


def _proj(kind: str, digits: int):
    return lambda s, d: rounded(views.project(peaks_dataset(s, d), kind), value=digits).select("pixel_id", "value")


def _image_tic(s, d):
    return rounded(views.projection_image(peaks_dataset(s, d), "tic"), value=2).select("gy", "gx", "value")


def _spectrum(s, d):
    return rounded(views.pixel_spectrum(peaks_dataset(s, d), 4, 5), mz=6, intensity=2).select("mz", "intensity")


def _roi_matrix(method: str):
    return lambda s, d: rounded(views.roi_matrix_spectrum(cells_dataset(s, d), [FG], method), value=6).select("channel", "mz", "value")


def _roi_raw(method: str):
    return lambda s, d: rounded(views.roi_raw_spectrum(peaks_dataset(s, d), [FG], method), mz=6, value=2).select("bin", "mz", "value")


def _ref_ions(p):
    def run(s, d):
        return rounded(refs(peaks_dataset(s, d), p)[0], mz=6, prevalence=6).select("ref_id", "mz", "prevalence", "n_obs")

    return run


def _ref_obs(s, d):
    return rounded(refs(peaks_dataset(s, d))[1], mz=6, intensity=2, ppm_error=4).select("pixel_id", "ref_id", "mz", "intensity", "ppm_error")


def _curve(b: int):
    def run(s, d):
        ds = peaks_dataset(s, d)
        c = tolerance.tolerance_curve(*refs(ds), ds.pixels, tolerance.ToleranceParams(bootstrap_B=b, block_bootstrap=False), 7)
        cols = ["i", "mz_grid", "ppm_quantile"] + (["ci_low", "ci_high"] if b else [])
        return rounded(c, mz_grid=5, ppm_quantile=4, ci_low=4, ci_high=4).select(*cols)

    return run


def _block_bootstrap(s, d):
    ds = peaks_dataset(s, d)
    c = tolerance.tolerance_curve(*refs(ds), ds.pixels, tolerance.ToleranceParams(), 7, 16)
    return rounded(c, mz_grid=5, ppm_quantile=4, ci_low=4, ci_high=4).select("i", "mz_grid", "ppm_quantile", "ci_low", "ci_high")


def _lock(strategy: str):
    def run(s, d):
        ds = peaks_dataset(s, d)
        f = recalibrate.lock_factors(*refs(ds), recalibrate.LockMassParams(strategy, explicit_anchor_mz=455.0))
        return f.select("pixel_id", F.round((F.col("factor") - 1) * 1e6, 4).alias("shift_ppm"))

    return run


def _warps(ds: MsiDataset):
    r, o = refs(ds)
    p = recalibrate.WarpParams(ransac_threshold_ppm=6.0)
    return recalibrate.warps(recalibrate.anchors(r, o, None, p), p, 7)


def _msiwarp(s, d):
    ds = peaks_dataset(s, d)
    return rounded(recalibrate.warped(ds.peaks, _warps(ds)), mz=5, intensity=2).select("pixel_id", "peak_idx", "mz", "intensity")


def _inliers(s, d):
    return _warps(peaks_dataset(s, d)).select("pixel_id", "n_inliers")


def _norm(method: str):
    def run(s, d):
        ds = peaks_dataset(s, d)
        f = normalize.with_reference_factor(ds.peaks, refs(ds)[1], 1e-12) if method == "reference" else normalize.with_factor(ds.peaks, method, 1e-12)
        return rounded(normalize.scaled(f), mz=6, intensity=8).select("pixel_id", "peak_idx", "mz", "intensity")

    return run


def _pick(p):
    def run(s, d):
        t = pick.with_threshold(peaks_dataset(s, d).peaks, p).where("intensity > threshold")
        return rounded(t, mz=6, intensity=2, threshold=3).select("pixel_id", "peak_idx", "mz", "intensity", "threshold")

    return run


def _cwt(s, d):
    p = cwt.CwtParams(width_min_ppm=20.0, width_max_ppm=80.0, n_widths=4, grid_ppm_step=5.0, min_snr=1.0)
    return rounded(cwt.cwt_pick(profile_spectra(s, d), 200.0, 200.0 * (1 + 20e-6) ** 63, p), mz=5, intensity=5).select("pixel_id", "peak_idx", "mz", "intensity")


def _kde(what: str):
    def run(s, d):
        ds = peaks_dataset(s, d)
        if what == "maxima":
            m = consensus.maxima(consensus.density(ds.peaks, KDE), KDE.min_prominence_quantile)
            return rounded(m, mz=5, density=4).select("g", "mz", "density", "prominent")
        cells, channels, every, _ = consensus.align_kde(ds, KDE)
        if what == "cells":
            return rounded(cells, intensity=2).select("pixel_id", "channel", "intensity")
        if what == "axis":
            return rounded(channels, mz=5, prevalence=6).select("channel", "mz", "prevalence", "n_peaks")
        return every.agg(F.count("*").alias("n_candidates"), F.count_if(F.col("prevalence") >= KDE.min_prevalence).alias("n_kept"), F.count_if(F.col("prevalence") < KDE.min_prevalence).alias("n_rejected"), F.round(F.median("prevalence"), 6).alias("prevalence_median"))

    return run


DB_EPS_PPM, DB_SAMPLES = 30.0, 4


def _dbscan(what: str):
    def run(s, d):
        import math

        ds = sparse_peaks(s, d)
        # In the SQL a cluster without intensity has no centroid (0 / 0), and its channel comes last.
        cells, channels = dbscan.cluster_channels(dbscan.dbscan(ds.peaks, math.log1p(DB_EPS_PPM * 1e-6), DB_SAMPLES), ds.n_pixels(), weightless=math.nan)
        return rounded(cells, intensity=4).select("pixel_id", "channel", "intensity") if what == "cells" else rounded(channels, mz=5, prevalence=6).select("channel", "mz", "prevalence", "n_peaks")

    return run


def _channel_table(s, d):
    return rounded(views.channel_table(cells_dataset(s, d)), prevalence=6).select("channel", "mz", "prevalence")


def _top(s, d):
    return rounded(views.top_channels(cells_dataset(s, d), 10), prevalence=6).select("channel", "mz", "prevalence")


def _nearest(s, d):
    return views.nearest_channel(cells_dataset(s, d), 123.5).select("channel", "mz")


def _channel_image(s, d):
    return rounded(views.channel_image(cells_dataset(s, d), 7), value=6).select("gy", "gx", "value")


def _nearest_join(s, d):
    from .functions.axis import nearest

    ds = peaks_dataset(s, d)
    axis = numbered(ds.peaks.sparkSession.range(25).select(F.lit("all").alias("dataset_id"), (215.0 + 20.0 * F.col("id")).alias("mz")))
    got = nearest(ds.peaks, axis).groupBy("pixel_id", "channel").agg(F.max("intensity").alias("intensity"))
    return rounded(got, intensity=2)


def _whatif(s, d):
    return views.survivors(views.channel_table(cells_dataset(s, d)), "prevalence", [0.3, 0.4, 0.45, 0.5, 0.55, 0.6], 0.5)


def _cdf(s, d):
    return rounded(views.cdf(views.channel_table(cells_dataset(s, d)), "prevalence"), value=6, share=6)


def _hist(bins):
    def run(s, d):
        f = normalize.with_factor(peaks_dataset(s, d).peaks, "median", 1e-12).groupBy("pixel_id").agg(F.first("factor").alias("factor"))
        return rounded(views.histogram(f, "factor", bins), left=3, right=3)

    return run


def _hist_counts(s, d):
    n = peaks_dataset(s, d).peaks.groupBy("pixel_id").agg(F.count("*").alias("n"))
    return rounded(views.histogram(n, "n", "integer"), left=3, right=3)


def _plotted(s, d):
    ds = peaks_dataset(s, d)
    return rounded(views.plotted_mz(views.pixel_spectrum(ds, 4, 5), views.pixel_spectrum(ds, 5, 5)), mz=6)


def _pair(s, d) -> str:
    """All peaks, written as a new imzML pair."""
    folder = f"{shared_dir(s)}/imzml-{uuid.uuid4().hex}"
    os.makedirs(files.mounted(folder))
    imzml.write_imzml(peaks_dataset(s, d), f"{folder}/image.imzML")
    return f"{folder}/image.imzML"


def _imzml(s, d):
    """Written and read back: intensities are 32-bit then, and peaks are numbered anew."""
    return rounded(imzml.read_imzml(s, _pair(s, d)).peaks, mz=6, intensity=2).select("pixel_id", "peak_idx", "mz", "intensity")


def _imzml_pixels(s, d):
    """A range of pixels of the pair: the source reads their spectra alone."""
    p = imzml.read_imzml(s, _pair(s, d), pixels=(100, 132)).peaks
    return rounded(p.groupBy("pixel_id").agg(F.count("*").alias("n"), F.sum("intensity").alias("tic")), tic=0)


def _tiff(s, d):
    """All channel images, written as pages of strips and read back."""
    folder = files.mounted(f"{shared_dir(s)}/tiff-{uuid.uuid4().hex}")
    os.makedirs(folder)
    tiff.write_tiff(cells_dataset(s, d), f"{folder}/image.tiff")
    return rounded(tiff.read_cells(s, f"{folder}/image.tiff"), intensity=6)


def _contrast(s, d):
    return rounded(views.contrast(views.project(peaks_dataset(s, d), "tic")), low=2, high=2).select("low", "high")


def _fdr(method: str):
    def run(s, d):
        ds = cells_dataset(s, d)
        t = prevalence.prevalence_test(ds.cells, ds.channels, ds.n_pixels(), prevalence.PrevalenceFdrParams(method=method), 7)
        return rounded(t, p=6, q=6).select("channel", "obs", "balls", "p", "q", "kept")

    return run


def _moran(kind: str):
    def run(s, d):
        ds = cells_dataset(s, d)
        e = moran.neighbours(ds.pixels, moran.QUEEN if kind == "queen" else moran.ROOK)
        return rounded(moran.moran(ds.cells, e, ds.n_pixels(), ["dataset_id", "channel"]), i=6).select("channel", "i")

    return run


def _moran_fdr(s, d):
    ds = cells_dataset(s, d)
    t = moran.moran_test(ds.cells, ds.channels, ds.pixels, moran.MoranParams(q_threshold=0.2), 7)
    return rounded(t, i=6, p=6, q=6).select("channel", "i", "p", "q", "kept")


HOT_K = 2.0


def _hot(what: str):
    def run(s, d):
        ds = cells_dataset(s, d) if what == "pm" else peaks_dataset(s, d)
        tic = hot_pixel.tics(ds.pixels, ds.cells if what == "pm" else ds.peaks)
        hot = hot_pixel.hot_pixels(tic, HOT_K)
        if what == "mark":
            return rounded(hot, tic=2, threshold=2).select("pixel_id", "tic", "threshold")
        p = hot_pixel.HotPixelParams(k_mad=HOT_K, correction="zero" if what == "zero" else "neighbors_median")
        if what == "pm":
            return rounded(hot_pixel.correct_cells(ds.cells, hot, ds.pixels, p), intensity=6).select("pixel_id", "channel", "intensity")
        return rounded(hot_pixel.correct_peaks(ds.peaks, tic, hot, ds.pixels, p), intensity=3).select("pixel_id", "peak_idx", "intensity")

    return run


def _bg(what: str):
    def run(s, d):
        ds = cells_dataset(s, d)
        r = background.ratios(ds.cells, ds.channels, background.masks(ds.pixels, (FG, BG), True), 1e-9)
        if what == "subtract":
            return rounded(background.subtracted(ds.cells, r), intensity=6).select("pixel_id", "channel", "intensity")
        return rounded(r.where("ratio < 1.0"), mean_fg=6, mean_bg=6, ratio=6).select("channel", "mz", "mean_fg", "mean_bg", "ratio")

    return run


#: The defaults but for anchors, as a dataset of the cohort has a third of the peaks, and for noise (see _default).
COHORT = cohort.CohortParams(reference=REF, snr_mad=0.5)


def _cohort(what: str):
    def run(s, d):
        r = cohort.align_cohort(peaks_dataset(s, d, cohort=True), COHORT)
        if what == "axis":
            return rounded(r.axis, mz=5).select("channel", "mz")
        return rounded(r.per_dataset, mz=5, prevalence=6).select("dataset_id", "channel", "mz", "prevalence", "n_peaks")

    return run


def _growth(s, d):
    """The cohort's datasets added one after another, the first again at last."""
    ds = peaks_dataset(s, d, cohort=True)
    folder = f"{shared_dir(s)}/cohort-{uuid.uuid4().hex}"
    # As acquisitions are: the peaks of each dataset in a folder of their own, so that adding one reads no other.
    ds.peaks.write.partitionBy("dataset_id").parquet(f"{folder}/acquired")
    ds = ds.with_(peaks=s.read.schema(ds.peaks.schema).parquet(f"{folder}/acquired"))
    c = cohort.GrowingCohort(s, folder, COHORT)
    for name in ("A", "N", "R", "A"):
        c.add(ds.with_(pixels=ds.pixels.where(F.col("dataset_id") == name), peaks=ds.peaks.where(F.col("dataset_id") == name)))
    return rounded(c.align().prevalence, mz=5, prevalence=6)


def _grades(s, d):
    ds = cells_dataset(s, d)
    t = ds.channels.agg(F.count("*").cast("double").alias("n_channels"), F.min("prevalence").alias("prevalence_min"), F.median("prevalence").alias("prevalence_median"))
    return rounded(diagnostics.graded(t, "channels"), value=6)


def _graded(node: str, op: str, params, with_refs: bool = False, data=peaks_dataset):
    """The summary of an operator, graded."""

    def run(s, d):
        ds = data(s, d)
        if with_refs:
            ds = ds.with_extras(**dict(zip(("ref_ions", "ref_obs"), refs(ds), strict=True)))
        return rounded(diagnostics.graded(operator(op).apply(ds, params, seed=7).diagnostics[0].summary, node), value=6)

    return run


def _default(s, d):
    # The tables' intensities are even, without a floor of noise: three deviations would leave next to nothing.
    return rounded(pipeline.default_channels(peaks_dataset(s, d), pick=pick.SnrParams(snr_mad=0.5)), mz=4, prevalence=6)


def queries() -> dict:
    out = {f"proj_{k}": _proj(k, n) for k, n in (("tic", 2), ("rms", 3), ("median", 3), ("base_peak", 2), ("peak_count", 0), ("mean_mz", 5))}
    out |= {"image_raster_tic": _image_tic, "pixel_spectrum": _spectrum, "contrast_tic": _contrast}
    out |= {f"roi_spectrum_matrix_{m}": _roi_matrix(m) for m in ("mean", "median", "sum", "max")}
    out |= {f"roi_spectrum_raw_{m}": _roi_raw(m) for m in ("sum", "mean", "max")}
    out |= {"ref_ions": _ref_ions(REF), "ref_ions_unmerged": _ref_ions(reference_ions.ReferenceIonParams(min_prevalence=0.3, merge_adjacent_bins=False)), "ref_obs_ppm": _ref_obs}
    out |= {"tolerance_curve": _curve(0), "tolerance_bootstrap_ci": _curve(1000), "tolerance_block_bootstrap": _block_bootstrap}
    out |= {f"recal_lock_mass_{n}": _lock(k) for n, k in (("intensity", "highest_intensity"), ("prevalence", "highest_prevalence"), ("closest", "closest_to_mz"))}
    out |= {"recal_msiwarp": _msiwarp, "recal_msiwarp_inliers": _inliers}
    out |= {"norm_median": _norm("median"), "norm_tic": _norm("tic"), "norm_reference": _norm("reference")}
    out |= {"pick_snr": _pick(pick.SnrParams(snr_mad=1.5)), "pick_snr_quantile": _pick(pick.SnrParams(snr_mad=0.5, min_intensity_quantile=0.6, min_intensity_abs=1000.0)), "pick_cwt": _cwt}
    out |= {"consensus_kde_maxima": _kde("maxima"), "consensus_kde_axis": _kde("axis"), "consensus_kde_cells": _kde("cells"), "consensus_budget": _kde("budget")}
    out |= {"consensus_dbscan_axis": _dbscan("axis"), "consensus_dbscan_cells": _dbscan("cells")}
    out |= {"channel_table": _channel_table, "channel_topn": _top, "channel_nearest": _nearest, "channel_image": _channel_image, "axis_nearest_join": _nearest_join}
    out |= {"whatif_prevalence": _whatif, "cdf_prevalence": _cdf, "hist_factor": _hist(16), "hist_factor_sqrt": _hist("sqrt"), "hist_peak_counts": _hist_counts, "plotted_mz": _plotted}
    out |= {"imzml_round_trip": _imzml, "imzml_some_pixels": _imzml_pixels, "tiff_round_trip": _tiff}
    out |= {"fdr_prevalence": _fdr("draws"), "fdr_prevalence_exact": _fdr("exact")}
    out |= {"morans_i_queen": _moran("queen"), "morans_i_rook": _moran("rook"), "morans_i_fdr": _moran_fdr}
    out |= {"hot_pixels_mark": _hot("mark"), "hot_pixels_zero": _hot("zero"), "hot_pixels_neighbors_pl": _hot("pl"), "hot_pixels_neighbors_pm": _hot("pm")}
    out |= {"bg_reject": _bg("reject"), "bg_subtract": _bg("subtract")}
    out |= {"cohort_axis": _cohort("axis"), "cohort_prevalence": _cohort("per"), "cohort_growth": _growth}
    out |= {
        "diag_hot_pixels": _graded("hot", "hot_pixel_filter", hot_pixel.HotPixelParams(k_mad=HOT_K, correction="mark")),
        "diag_lock_mass": _graded("lock", "lock_mass_recalibrate", recalibrate.LockMassParams("closest_to_mz", explicit_anchor_mz=455.0), True),
        "diag_warp": _graded("recal", "msiwarp_recalibrate", recalibrate.WarpParams(ransac_threshold_ppm=6.0), True),
        "diag_dbscan": _graded("consensus", "dbscan_consensus", dbscan.DbscanParams(DB_EPS_PPM, DB_SAMPLES, 0.0), data=sparse_peaks),
        "diag_prevalence_fdr": _graded("fdr", "prevalence_fdr_filter", prevalence.PrevalenceFdrParams(q_threshold=1.5), data=cells_dataset),
    }
    out |= {"diag_grades": _grades, "pipeline_default": _default}
    return out


def oracle_sql() -> dict:
    return O.sql()

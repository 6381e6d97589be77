"""Peak picking by a robust noise threshold for each pixel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..model import PIXEL, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, kept_per_pixel, one_row, register


@dataclass(frozen=True)
class SnrParams:
    snr_mad: float = 3.0
    min_intensity_quantile: float = 0.0
    min_intensity_abs: float = 0.0


def with_threshold(peaks: DataFrame, p: SnrParams) -> DataFrame:
    """``peaks`` with their pixel's ``threshold``; all windows share one partitioning by pixel."""
    by = Window.partitionBy(*PIXEL)
    i = F.col("intensity").cast("double")
    out = peaks.withColumn("_m", F.median(i).over(by)).withColumn("_mad", F.median(F.abs(i - F.col("_m"))).over(by))
    parts = [F.lit(p.snr_mad * MAD_SCALE) * F.col("_mad"), F.lit(float(p.min_intensity_abs))]
    if p.min_intensity_quantile > 0:
        out = out.withColumn("_q", F.percentile(i, F.lit(p.min_intensity_quantile)).over(by))
        parts.append(F.col("_q"))
    return out.withColumn("threshold", F.greatest(*parts)).drop("_m", "_mad", "_q")


@register
class SnrPeakPick(Operator):
    name = "snr_peak_pick"
    params_cls = SnrParams

    def run(self, ds: MsiDataset, params: SnrParams, seed: int) -> OpResult:
        t = hold(with_threshold(ds.need_peaks(self.name), params))
        kept = t.where("intensity > threshold")
        summary = t.agg(F.count("*").cast("double").alias("n_peaks_in"), F.count_if(F.col("intensity") > F.col("threshold")).cast("double").alias("n_peaks_out"))
        level = ds.pixels.select(*PIXEL).join(t.groupBy(*PIXEL).agg(F.first("threshold").alias("t")), PIXEL, "left").agg(F.median(F.coalesce("t", F.lit(0.0))).alias("threshold_median"))
        summary = one_row(summary.withColumns({"fraction_kept": F.coalesce(F.try_divide("n_peaks_out", "n_peaks_in"), F.lit(0.0)), "snr_mad": F.lit(float(params.snr_mad))}), level, kept_per_pixel(ds.pixels, kept))
        return OpResult(ds.with_peaks(kept.drop("threshold")), (Diagnostic(self.name, summary, {}, "histogram:peaks_per_pixel"),))

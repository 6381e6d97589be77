"""Intensity normalisation: one factor a pixel, as a window over its peaks (one shuffle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PIXEL, MsiDataset
from .base import Diagnostic, Operator, OpResult, numbers, one_row, register


@dataclass(frozen=True)
class NormalizeParams:
    """``method`` is accepted for old specs; the operator's name decides."""

    method: str = ""
    eps: float = 1e-12


@dataclass(frozen=True)
class ReferenceNormalizeParams:
    eps: float = 1e-12


def with_factor(peaks: DataFrame, method: str, eps: float) -> DataFrame:
    """``peaks`` with ``factor``: the median of non-zero intensities, or their sum, at least ``eps``."""
    by = Window.partitionBy(*PIXEL)
    value = F.median(F.when(F.col("intensity") > 0, F.col("intensity").cast("double"))).over(by) if method == "median" else F.sum(F.col("intensity").cast("double")).over(by)
    return peaks.withColumn("factor", F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(eps)))


def with_reference_factor(peaks: DataFrame, ref_obs: DataFrame, eps: float) -> DataFrame:
    f = ref_obs.groupBy(*PIXEL).agg(F.sum("intensity").alias("factor"))
    return peaks.join(f, PIXEL, "left").withColumn("factor", F.greatest(F.coalesce("factor", F.lit(0.0)), F.lit(eps)))


def scaled(peaks: DataFrame) -> DataFrame:
    return peaks.withColumn("intensity", F.col("intensity").cast("double") / F.col("factor")).drop("factor")


def _result(op: Operator, ds: MsiDataset, with_f: DataFrame, *more: DataFrame, notes: tuple[str, ...] = (), eps: float | None = None, **constants: float) -> OpResult:
    factors = with_f.groupBy(*PIXEL).agg(F.first("factor").alias("factor"))
    quartile = lambda q: F.percentile("factor", F.lit(q)).alias(f"factor_q{round(100 * q)}")
    floor = [] if eps is None else [F.count_if(F.col("factor") <= eps).cast("double").alias("n_pixels_at_floor")]
    summary = one_row(factors.agg(F.min("factor").alias("factor_min"), quartile(0.25), F.median("factor").alias("factor_median"), quartile(0.75), F.max("factor").alias("factor_max"), *floor, *numbers(**constants)), *more)
    return OpResult(ds.with_peaks(scaled(with_f)), (Diagnostic(op.name, summary, {"factors": factors}, "histogram:factor", notes),))


@register
class MedianNormalize(Operator):
    name = "median_normalize"
    params_cls = NormalizeParams

    def run(self, ds: MsiDataset, params: NormalizeParams, seed: int) -> OpResult:
        return _result(self, ds, with_factor(ds.need_peaks(self.name), "median", params.eps), factor_kind_tic=0)


@register
class TicNormalize(Operator):
    name = "tic_normalize"
    params_cls = NormalizeParams

    def validate(self, ep) -> list[str]:
        return ["The total ion current follows the few strongest ions; the median is usually the safer factor."]

    def run(self, ds: MsiDataset, params: NormalizeParams, seed: int) -> OpResult:
        return _result(self, ds, with_factor(ds.need_peaks(self.name), "tic", params.eps), notes=tuple(self.validate(ds.metadata)), factor_kind_tic=1)


@register
class ReferenceIonNormalize(Operator):
    name = "reference_ion_normalize"
    params_cls = ReferenceNormalizeParams

    def run(self, ds: MsiDataset, params: ReferenceNormalizeParams, seed: int) -> OpResult:
        refs = ds.extras.get("ref_obs")
        if refs is None or refs.isEmpty():
            raise RuntimeError(f"{self.name} needs reference ions; detect them first")
        n = refs.agg(F.count_distinct("dataset_id", "ref_id").cast("double").alias("n_reference_ions"))
        return _result(self, ds, with_reference_factor(ds.need_peaks(self.name), refs, params.eps), n, eps=params.eps)

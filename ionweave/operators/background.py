"""Channels of the matrix or slide, found by comparing regions inside and outside the sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import in_any
from ..model import DATASET, PIXEL, MsiDataset, RoiDef
from .base import Diagnostic, Operator, OpResult, numbers, register
from .consensus import keep_channels, need_some


@dataclass(frozen=True)
class BackgroundParams:
    mode: str = "reject_channels"
    bg_to_fg_ratio_threshold: float = 0.5
    use_outside_as_bg: bool = True
    eps: float = 1e-9

    def __post_init__(self) -> None:
        if self.mode not in ("reject_channels", "subtract"):
            raise ValueError(f"unknown mode {self.mode!r}")


def masks(pixels: DataFrame, rois: tuple[RoiDef, ...], outside: bool) -> DataFrame:
    """(dataset_id, pixel_id, fg, bg): regions of the sample and of the background; a missing kind is
    the complement of the other (of the sample only where ``outside`` holds)."""
    if not rois:
        raise RuntimeError("background_subtract needs at least one region")
    y, x = F.col("gy").cast("double"), F.col("gx").cast("double")
    fg = in_any([r for r in rois if not r.is_background], y, x)
    bg = in_any([r for r in rois if r.is_background], y, x)
    has_fg, has_bg = any(not r.is_background for r in rois), any(r.is_background for r in rois)
    if has_fg and not has_bg:
        bg = ~fg if outside else F.lit(False)
    elif has_bg and not has_fg:
        fg = ~bg
    return pixels.select(*PIXEL, fg.alias("fg"), bg.alias("bg"))


def ratios(cells: DataFrame, channels: DataFrame, m: DataFrame, eps: float) -> DataFrame:
    """``channels`` with mean_fg, mean_bg (zeros counted) and ratio."""
    n = m.groupBy("dataset_id").agg(F.count_if("fg").alias("n_fg"), F.count_if("bg").alias("n_bg"))
    i = F.col("intensity").cast("double")
    s = cells.join(m, PIXEL).groupBy("dataset_id", "channel").agg(F.sum(F.when(F.col("fg"), i)).alias("s_fg"), F.sum(F.when(F.col("bg"), i)).alias("s_bg"))
    c = channels.join(s, ["dataset_id", "channel"], "left").join(n, DATASET)
    mean = lambda k: F.coalesce(F.try_divide(f"s_{k}", f"n_{k}"), F.lit(0.0)).alias(f"mean_{k}")
    c = c.select(*channels.columns, mean("fg"), mean("bg"))
    return c.withColumn("ratio", F.col("mean_bg") / F.greatest(F.col("mean_fg"), F.lit(eps)))


def subtracted(cells: DataFrame, r: DataFrame) -> DataFrame:
    """Cells less the channel's mean background, never below 0."""
    out = cells.join(r.select("dataset_id", "channel", "mean_bg"), ["dataset_id", "channel"])
    return out.select(*PIXEL, "channel", F.greatest(F.lit(0.0), F.col("intensity") - F.col("mean_bg")).alias("intensity")).where("intensity > 0")


@register
class BackgroundSubtract(Operator):
    name = "background_subtract"
    params_cls = BackgroundParams

    def run(self, ds: MsiDataset, params: BackgroundParams, seed: int) -> OpResult:
        cells = ds.need_cells(self.name)
        m = masks(ds.pixels, ds.rois, params.use_outside_as_bg)
        n = m.agg(F.count_if("fg"), F.count_if("bg")).first()
        if not n[0] or not n[1]:
            raise RuntimeError(f"{self.name}: the {'foreground' if not n[0] else 'background'} has no pixels")
        r = ratios(cells, ds.channels, m, params.eps)
        if params.mode == "subtract":
            out = ds.with_(cells=subtracted(cells, r))
        else:
            kept = keep_channels(cells, r, F.col("ratio") < params.bg_to_fg_ratio_threshold)
            need_some(kept[1], f"no channel has a ratio below {params.bg_to_fg_ratio_threshold}")
            out = ds.with_matrix(kept[0], kept[1].select(*ds.channels.columns))
        left = F.count("*") if params.mode == "subtract" else F.count_if(F.col("ratio") < params.bg_to_fg_ratio_threshold)
        summary = r.agg(
            F.count("*").cast("double").alias("n_channels_in"), left.cast("double").alias("n_channels_out"), F.median("ratio").alias("ratio_median"), F.max("ratio").alias("ratio_max"),
            *numbers(n_fg_pixels=n[0], n_bg_pixels=n[1], bg_to_fg_ratio_threshold=params.bg_to_fg_ratio_threshold, mode_reject_channels=params.mode != "subtract"),
        )
        return OpResult(out.with_extras(background=r), (Diagnostic(self.name, summary, {"ratios": r}, "scatter:fg_vs_bg"),))

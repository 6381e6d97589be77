"""Pixels of outlying total ion current: marked, zeroed, or brought to their neighbours' level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE
from ..functions.grid import neighbours
from ..model import DATASET, PIXEL, MsiDataset
from .base import Diagnostic, Operator, OpResult, numbers, one_row, register


@dataclass(frozen=True)
class HotPixelParams:
    k_mad: float = 5.0
    correction: str = "neighbors_median"
    min_neighbors: int = 3

    def __post_init__(self) -> None:
        if self.correction not in ("neighbors_median", "zero", "mark"):
            raise ValueError(f"unknown correction {self.correction!r}")


def tics(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """(dataset_id, pixel_id, tic) of every populated pixel; 0 without peaks."""
    t = values.groupBy(*PIXEL).agg(F.sum(F.col("intensity").cast("double")).alias("tic"))
    return pixels.select(*PIXEL).join(t, PIXEL, "left").withColumn("tic", F.coalesce("tic", F.lit(0.0)))


def limits(tic: DataFrame, k_mad: float) -> DataFrame:
    """(dataset_id, m, mad, threshold): median + k * 1.4826 * MAD of the TIC."""
    m = tic.groupBy("dataset_id").agg(F.median("tic").alias("m"))
    mad = tic.join(m, DATASET).groupBy("dataset_id", "m").agg(F.median(F.abs(F.col("tic") - F.col("m"))).alias("mad"))
    return mad.withColumn("threshold", F.col("m") + F.lit(k_mad * MAD_SCALE) * F.col("mad"))


def hot_pixels(tic: DataFrame, k_mad: float) -> DataFrame:
    """(dataset_id, pixel_id, tic, threshold) of the pixels over their dataset's limit."""
    return tic.join(limits(tic, k_mad).select("dataset_id", "threshold"), DATASET).where("tic > threshold")


def good_neighbours(hot: DataFrame, pixels: DataFrame) -> DataFrame:
    """(dataset_id, pixel_id, neighbour_id): the populated neighbours of hot pixels that aren't hot."""
    n = neighbours(pixels).join(hot.select(*PIXEL), PIXEL, "left_semi")
    return n.join(hot.select("dataset_id", F.col("pixel_id").alias("neighbour_id")), ["dataset_id", "neighbour_id"], "left_anti").select(*PIXEL, "neighbour_id")


def correct_peaks(peaks: DataFrame, tic: DataFrame, hot: DataFrame, pixels: DataFrame, p: HotPixelParams) -> DataFrame:
    """Hot pixels are scaled to the median TIC of their neighbours, or zeroed with too few of them."""
    if p.correction == "zero":
        scale = hot.select(*PIXEL, F.lit(0.0).alias("scale"))
    else:
        near = good_neighbours(hot, pixels).join(tic.select("dataset_id", F.col("pixel_id").alias("neighbour_id"), F.col("tic").alias("t")), ["dataset_id", "neighbour_id"])
        level = near.groupBy(*PIXEL).agg(F.count("*").alias("n"), F.median("t").alias("level"))
        scale = hot.join(level, PIXEL, "left").select(*PIXEL, F.when(F.coalesce("n", F.lit(0)) < p.min_neighbors, 0.0).otherwise(F.coalesce(F.try_divide("level", "tic"), F.lit(1.0))).alias("scale"))
    out = peaks.join(scale, PIXEL, "left")
    return out.withColumn("intensity", F.col("intensity") * F.coalesce("scale", F.lit(1.0))).drop("scale")


def correct_cells(cells: DataFrame, hot: DataFrame, pixels: DataFrame, p: HotPixelParams) -> DataFrame:
    """Hot pixels take the per-channel median of their neighbours, absent cells counting as 0."""
    rest = cells.join(hot.select(*PIXEL), PIXEL, "left_anti")
    if p.correction == "zero":
        return rest
    near = good_neighbours(hot, pixels)
    n = near.groupBy(*PIXEL).agg(F.count("*").alias("n")).where(F.col("n") >= p.min_neighbors)
    seen = near.join(n, PIXEL).join(cells.select("dataset_id", F.col("pixel_id").alias("neighbour_id"), "channel", "intensity"), ["dataset_id", "neighbour_id"])
    lists = seen.groupBy(*PIXEL, "channel", "n").agg(F.collect_list(F.col("intensity").cast("double")).alias("v"))  # eight at most
    full = F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), (F.col("n") - F.size("v")).cast("int"))))
    at = lambda k: F.get("f", k)
    half = (F.col("n") / 2).cast("int")
    median = F.when(F.col("n") % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)
    new = lists.withColumn("f", full).select(*PIXEL, "channel", median.alias("intensity")).where("intensity > 0")
    return rest.select(*PIXEL, "channel", F.col("intensity").cast("double").alias("intensity")).unionByName(new)


@register
class HotPixelFilter(Operator):
    name = "hot_pixel_filter"
    params_cls = HotPixelParams

    def run(self, ds: MsiDataset, params: HotPixelParams, seed: int) -> OpResult:
        values = ds.cells if ds.is_matrix else ds.need_peaks(self.name)
        tic = tics(ds.pixels, values)
        hot = hot_pixels(tic, params.k_mad)
        out = ds.with_extras(hot_pixels=hot)
        if params.correction != "mark":
            out = out.with_(cells=correct_cells(ds.cells, hot, ds.pixels, params)) if ds.is_matrix else out.with_peaks(correct_peaks(ds.peaks, tic, hot, ds.pixels, params))
        # Of several datasets, the medians of their limits.
        level = limits(tic, params.k_mad).agg(F.median("m").alias("tic_median"), F.median("mad").alias("tic_mad"), F.median("threshold").alias("tic_threshold"), *numbers(k_mad=params.k_mad))
        n = one_row(hot.agg(F.count("*").cast("double").alias("n_hot_pixels")), tic.agg(F.count("*").alias("n")))
        summary = one_row(n.select("n_hot_pixels", F.coalesce(F.try_divide("n_hot_pixels", "n"), F.lit(0.0)).alias("fraction_hot")), level)
        return OpResult(out, (Diagnostic(self.name, summary, {"hot_pixels": hot}, "image:tic"),))

"""Density clusters of log m/z (one-dimensional DBSCAN), exact and without a task that sees all peaks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import numbered
from ..functions.exprs import weighted_mean
from ..model import DATASET, PIXEL, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, one_row, prevalences, register
from .consensus import keep_channels, need_some


@dataclass(frozen=True)
class DbscanParams:
    eps_ppm: float = 0.0
    min_samples: int = 5
    min_prevalence: float = 0.05


def cells_of(points: DataFrame) -> DataFrame:
    """(dataset_id, cell, n, lo, hi, first): cells of half a radius; ``first`` is the earliest point in pool order."""
    return points.groupBy("dataset_id", "cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.struct("pixel_id", "peak_idx")).alias("first"))


def _near(cells: DataFrame, by: int, *cols: str) -> DataFrame:
    """``cells`` as seen from the cell ``by`` places to the left."""
    return cells.select("dataset_id", (F.col("cell") - by).alias("cell"), *(F.col(c).alias(f"{c}{by:+d}") for c in cols))


def core_cells(points: DataFrame, cells: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(dataset_id, cell, lo, hi, first) of the core points of each cell: those with at least ``min_samples``
    points within eps, itself included.

    All points of a cell and its two neighbours are within eps of each other's: where these are enough, the whole
    cell is core, from its counts alone, however many points it has. In other cells, which have less than
    ``min_samples`` points, each point looks at the nearest ``min_samples`` of the two cells beyond."""
    wide = cells.join(_near(cells, -1, "n"), ["dataset_id", "cell"], "left").join(_near(cells, 1, "n"), ["dataset_id", "cell"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wide = hold(wide.withColumn("n3", F.col("n") + zero("n-1") + zero("n+1")).select("dataset_id", "cell", "n3", "lo", "hi", "first"))
    sparse = wide.where(F.col("n3") < min_samples)
    loose = points.join(sparse.select("dataset_id", "cell", "n3"), ["dataset_id", "cell"])
    for by, order in ((2, F.col("x")), (-2, -F.col("x"))):
        # The rows of a full cell are cut to min_samples before they are shuffled.
        asked = sparse.select("dataset_id", (F.col("cell") + by).alias("cell"))
        rank = F.row_number().over(Window.partitionBy("dataset_id", "cell").orderBy(order))
        ends = points.join(asked, ["dataset_id", "cell"], "left_semi").select("dataset_id", "cell", "x").withColumn("r", rank).where(F.col("r") <= min_samples)
        ends = ends.groupBy("dataset_id", "cell").agg(F.collect_list("x").alias("v"))
        loose = loose.join(_near(ends, by, "v"), ["dataset_id", "cell"], "left")
    within = lambda c: F.coalesce(F.size(F.filter(c, lambda v: F.abs(v - F.col("x")) <= eps)), F.lit(0))
    core = loose.where(F.col("n3") + within("v-2") + within("v+2") >= min_samples)
    found = core.groupBy("dataset_id", "cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.struct("pixel_id", "peak_idx")).alias("first"))
    return wide.where(F.col("n3") >= min_samples).select("dataset_id", "cell", "lo", "hi", "first").unionByName(found)


def clusters(cores: DataFrame, eps: float) -> DataFrame:
    """(dataset_id, cluster, lo, hi, first): runs of cells whose core points are no more than eps apart."""
    over = Window.partitionBy("dataset_id").orderBy("lo")  # over occupied cells, not points
    new = F.coalesce((F.col("lo") - F.lag("hi").over(over) > eps).cast("int"), F.lit(0))
    isl = cores.withColumn("new", new).withColumn("cluster", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("dataset_id", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))


def labelled(points: DataFrame, c: DataFrame, eps: float) -> DataFrame:
    """``points`` in a cluster, with ``cluster``; a border point of two goes to the one whose first
    core point comes first in the pool. Noise is left out.

    Each cell knows the few clusters that reach into it, so a point chooses in its row."""
    at = lambda v: F.floor(v / F.lit(eps / 2)).cast("bigint")
    reach = c.withColumn("cell", F.explode(F.sequence(at(F.col("lo") - eps) - 1, at(F.col("hi") + eps) + 1)))
    reach = reach.groupBy("dataset_id", "cell").agg(F.sort_array(F.collect_list(F.struct("first", "cluster", "lo", "hi"))).alias("c"))
    x = F.col("x")
    mine = F.get(F.filter("c", lambda k: (k["lo"] - x <= eps) & (x - k["hi"] <= eps)), F.lit(0))
    got = points.join(reach, ["dataset_id", "cell"]).withColumn("k", mine).where("k IS NOT NULL")
    return got.select(*PIXEL, "peak_idx", "mz", "intensity", F.col("k.cluster").alias("cluster"))


def dbscan(peaks: DataFrame, eps: float, min_samples: int) -> DataFrame:
    x = F.log("mz")
    points = hold(peaks.select(*PIXEL, "peak_idx", "mz", "intensity", x.alias("x"), F.floor(x / F.lit(eps / 2)).cast("bigint").alias("cell")))
    found = hold(clusters(core_cells(points, hold(cells_of(points)), eps, min_samples), eps))
    return hold(labelled(points, found, eps))


def cluster_channels(hits: DataFrame, n_pixels: DataFrame, weightless: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, channels) of labelled peaks: centroid in m/z, strongest peak of each pixel.

    A cluster whose peaks have no intensity has its plain mean as centroid, or ``weightless`` if that is given."""
    weight = F.col("intensity").cast("double")
    centroid = weighted_mean("mz", weight) if weightless is None else F.coalesce(F.try_divide(F.sum(F.col("mz") * weight), F.sum(weight)), F.lit(weightless))
    every = hits.groupBy(*PIXEL, "cluster").agg(F.max("intensity").alias("intensity"))
    axis = hits.groupBy("dataset_id", "cluster").agg(centroid.alias("mz"), F.count("*").alias("n_peaks"))
    seen = every.groupBy("dataset_id", "cluster").agg(F.count_if(F.col("intensity") > 0).alias("seen"))
    ch = axis.join(seen, ["dataset_id", "cluster"]).join(n_pixels, DATASET).select("dataset_id", "cluster", "mz", (F.col("seen") / F.col("n_pixels")).alias("prevalence"), "n_peaks")
    ch = numbered(ch)
    cells = every.where("intensity > 0").join(ch.select("dataset_id", "cluster", "channel"), ["dataset_id", "cluster"]).select(*PIXEL, "channel", "intensity")
    return cells, ch.select("dataset_id", "channel", "mz", "prevalence", "n_peaks")


@register
class DbscanConsensus(Operator):
    name = "dbscan_consensus"
    params_cls = DbscanParams

    def eps(self, ds: MsiDataset, p: DbscanParams) -> float:
        if p.eps_ppm > 0:
            return math.log1p(p.eps_ppm * 1e-6)
        curve = ds.extras.get("tolerance_curve")
        median = curve.agg(F.median("ppm_quantile")).first()[0] if curve is not None else None
        return math.log1p((2 * median if median else 50.0) * 1e-6)

    def run(self, ds: MsiDataset, params: DbscanParams, seed: int) -> OpResult:
        eps = self.eps(ds, params)
        hits = dbscan(ds.need_peaks(self.name), eps, params.min_samples)
        cells, every = cluster_channels(hits, ds.n_pixels())
        cells, channels = keep_channels(cells, every, F.col("prevalence") >= params.min_prevalence)
        need_some(channels, f"no cluster reaches min_prevalence={params.min_prevalence}")
        summary = every.agg(
            F.count_if(F.col("prevalence") >= params.min_prevalence).cast("double").alias("n_consensus_peaks"), F.count("*").cast("double").alias("n_clusters_pre_filter"),
            *numbers(eps_log_mz=eps, eps_ppm_effective=math.expm1(eps) * 1e6, min_samples=params.min_samples),
        )
        noise = one_row(ds.peaks.agg(F.count("*").alias("n")), hits.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).cast("double").alias("n_noise_peaks"), (1 - F.col("k") / F.col("n")).alias("fraction_noise"))
        summary = one_row(summary, noise, prevalences(channels))
        return OpResult(ds.with_matrix(cells, channels).with_extras(candidates=every), (Diagnostic(self.name, summary, {"candidates": every}, "stem:mz_vs_prevalence"),))

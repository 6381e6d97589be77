"""An empirical m/z tolerance: a non-decreasing quantile curve of the anchors' ppm errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import isotonic, lerp, running_sums
from ..model import DATASET, PIXEL, MsiDataset, hold
from . import bootstrap
from .base import Diagnostic, Operator, OpResult, numbers, one_row, register

GRID_POINTS = 200
FLAT_PPM = 50.0
#: Anchors and pairs that a curve needs.
LEAST_REFS, LEAST_PAIRS = 3, 5


@dataclass(frozen=True)
class ToleranceParams:
    alpha: float = 0.01
    bootstrap_B: int = 1000
    block_bootstrap: bool = True
    block_size_pixels: int = 32


def _pairs(ref_ions: DataFrame, ref_obs: DataFrame) -> DataFrame:
    """(dataset_id, pixel_id, ref_id, x, y): anchor m/z against absolute ppm error."""
    return ref_obs.join(ref_ions.select("dataset_id", "ref_id", F.col("mz").alias("x")), ["dataset_id", "ref_id"]).select(*PIXEL, "ref_id", "x", F.abs("ppm_error").alias("y"))


def _edges(x: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct quantile edges of the weighted anchors (keys, ref_id, x, m): arrays ``edges``.

    Few anchors stand for all pairs, so their cumulated weights give the order statistics.
    """
    by = Window.partitionBy(*keys).orderBy("x", "ref_id")
    c = x.withColumn("upto", F.sum("m").over(by)).withColumn("n", F.sum("m").over(Window.partitionBy(*keys)))
    c = c.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("upto", "x"))).alias("c"))
    bins = F.greatest(F.lit(8), F.least(F.lit(30), F.floor(F.col("n") / 5)))
    at = lambda k: F.element_at(F.filter("c", lambda s: s["upto"] > k), 1)["x"]
    c = c.withColumn("bins", bins.cast("int"))

    def edge(j: Column) -> Column:
        pos = j / F.col("bins") * (F.col("n") - 1)
        lo = F.floor(pos)
        a, b = at(lo), at(F.least(lo + 1, F.col("n") - 1))
        return a + (b - a) * (pos - lo)

    return c.select(*keys, "n", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("bins")), edge))).alias("edges"))


def curve(pairs: DataFrame, alpha: float, keys: list[str], grid: DataFrame) -> DataFrame:
    """(keys, i, mz_grid, ppm): the isotonic (1 - alpha/2)-quantile curve of (keys, ref_id, x, y, m).

    ``grid``: (dataset_id, lo, hi), the range of the 200 points. ``m`` is how often a pair counts.
    """
    refs = pairs.groupBy(*keys, "ref_id", "x").agg(F.sum("m").alias("m"))
    edges = _edges(refs, keys)
    bin_of = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1).cast("int")
    placed = refs.join(edges, keys).select(*keys, "ref_id", bin_of.alias("bin"))
    q = 1 - alpha / 2
    # A single distinct x has no bins: its curve is the global quantile.
    per = pairs.join(placed, [*keys, "ref_id"]).groupBy(*keys, "bin").agg(F.percentile("y", F.lit(q), F.col("m")).alias("q"))
    every = edges.select(*keys, "edges", F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("b"))
    every = every.withColumn("bin", F.when(F.size("edges") < 2, 0).otherwise(F.col("b")))
    by = Window.partitionBy(*keys).orderBy("b")
    filled = every.join(per, [*keys, "bin"], "left").withColumn("q", F.coalesce(F.last("q", ignorenulls=True).over(by), F.lit(0.0)))
    centre = F.when(F.size("edges") < 2, F.element_at("edges", 1)).otherwise((F.element_at("edges", F.col("b")) + F.try_element_at("edges", F.col("b") + 1)) / 2)
    rows = filled.withColumn("centre", centre).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", "centre", "q"))).alias("r"))
    rows = rows.select(*keys, F.transform("r", lambda s: s["centre"]).alias("xs"), running_sums(F.transform("r", lambda s: s["q"])).alias("sums"))
    rows = rows.select(*keys, "xs", isotonic(F.col("sums")).alias("ys")).join(grid, DATASET)
    points = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))))
    points = points.withColumn("mz_grid", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (GRID_POINTS - 1))
    value = F.when(F.size("xs") == 1, F.col("ys")[0]).otherwise(lerp("mz_grid", F.col("xs"), F.col("ys")))
    return points.select(*keys, "i", "mz_grid", value.alias("ppm"))


def tolerance_curve(ref_ions: DataFrame, ref_obs: DataFrame, pixels: DataFrame, p: ToleranceParams, seed: int = 0, width: int = 1) -> DataFrame:
    """(dataset_id, i, mz_grid, ppm_quantile, ci_low, ci_high), 200 points a dataset.

    Fewer than three anchors or five pairs: flat at the global quantile, or 50 ppm without any.
    """
    pairs = hold(_pairs(ref_ions, ref_obs).withColumn("m", F.lit(1).cast("bigint")))
    stats = pairs.groupBy("dataset_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n_pairs"), F.percentile("y", F.lit(1 - p.alpha / 2)).alias("flat"))
    stats = pixels.select("dataset_id").distinct().join(ref_ions.groupBy("dataset_id").agg(F.count("*").alias("refs"), F.min("mz").alias("ref_lo"), F.max("mz").alias("ref_hi")), DATASET, "left").join(stats, DATASET, "left")
    good = (F.coalesce("refs", F.lit(0)) >= LEAST_REFS) & (F.coalesce("n_pairs", F.lit(0)) >= LEAST_PAIRS)
    grid = stats.where(good).select("dataset_id", "lo", "hi")
    fit = pairs.join(grid.select("dataset_id"), DATASET, "left_semi")
    point = curve(fit, p.alpha, DATASET, grid).withColumnRenamed("ppm", "ppm_quantile")
    if p.bootstrap_B > 0:
        band = bootstrap.band(fit, grid, pixels, p.bootstrap_B, p.alpha, seed, p.block_size_pixels if p.block_bootstrap else None, width)
        point = point.join(band, ["dataset_id", "i"], "left")
    else:
        point = point.withColumn("ci_low", F.col("ppm_quantile")).withColumn("ci_high", F.col("ppm_quantile"))
    lo, hi = F.coalesce("ref_lo", F.lit(0.0)), F.coalesce("ref_hi", F.lit(1.0))
    level = F.coalesce("flat", F.lit(FLAT_PPM))
    flat = stats.where(~good).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)))).select("dataset_id", "i", (lo + F.col("i") * (hi - lo) / (GRID_POINTS - 1)).alias("mz_grid"), level.alias("ppm_quantile"), level.alias("ci_low"), level.alias("ci_high"))
    return point.select("dataset_id", "i", "mz_grid", "ppm_quantile", "ci_low", "ci_high").unionByName(flat)


def evaluate(curve_df: DataFrame, points: DataFrame, mz: str, out: str) -> DataFrame:
    """``points`` with the curve's value at column ``mz``: the grid is uniform, so the interval's
    number follows from m/z and the 200 values of a dataset are one array."""
    c = curve_df.groupBy("dataset_id").agg(F.min("mz_grid").alias("_lo"), F.max("mz_grid").alias("_hi"), F.transform(F.sort_array(F.collect_list(F.struct("i", "ppm_quantile"))), lambda s: s["ppm_quantile"]).alias("_v"))
    h = (F.col("_hi") - F.col("_lo")) / (GRID_POINTS - 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(float(GRID_POINTS - 1)), F.coalesce(F.try_divide(F.col(mz) - F.col("_lo"), h), F.lit(0.0))))
    i = F.least(F.floor(t), F.lit(GRID_POINTS - 2)).cast("int")
    a, b = F.get("_v", i), F.get("_v", i + 1)
    return points.join(c, DATASET, "left").withColumn(out, a + (b - a) * (t - i)).drop("_lo", "_hi", "_v")


@register
class EmpiricalTolerance(Operator):
    name = "empirical_tolerance_from_reference_ions"
    params_cls = ToleranceParams

    def run(self, ds: MsiDataset, params: ToleranceParams, seed: int) -> OpResult:
        if "ref_ions" not in ds.extras:
            raise RuntimeError(f"{self.name} needs reference ions; detect them first")
        c = hold(tolerance_curve(ds.extras["ref_ions"], ds.extras["ref_obs"], ds.pixels, params, seed, max(ds.grid_shape[1], 1)))
        summary = c.agg(
            F.min_by("ppm_quantile", "i").alias("ppm_at_mz_lo"), F.max_by("ppm_quantile", "i").alias("ppm_at_mz_hi"), F.median("ppm_quantile").alias("ppm_median"),
            F.median(F.col("ci_high") - F.col("ci_low")).alias("ci_band_median_width"), *numbers(alpha=params.alpha, bootstrap_B=params.bootstrap_B),
        )
        # A dataset of fewer anchors or pairs than a curve needs has a flat tolerance.
        n = ds.pixels.select("dataset_id").distinct().join(ds.extras["ref_ions"].groupBy("dataset_id").agg(F.count("*").alias("refs")), DATASET, "left").join(ds.extras["ref_obs"].groupBy("dataset_id").agg(F.count("*").alias("pairs")), DATASET, "left")
        flat = (F.coalesce("refs", F.lit(0)) < LEAST_REFS) | (F.coalesce("pairs", F.lit(0)) < LEAST_PAIRS)
        summary = one_row(summary, n.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("double").alias("n_reference_observations"), F.max(flat.cast("double")).alias("warning_flat_tolerance")))
        return OpResult(ds.with_extras(tolerance_curve=c), (Diagnostic(self.name, summary, {"curve": c}, "line_with_band:mz_vs_tolerance"),))

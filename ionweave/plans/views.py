"""Ad-hoc queries on datasets: projections, spectra, channel images, what-if counts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import assign
from ..functions.grid import image, roi_pixels
from ..model import PIXEL, MsiDataset, RoiDef

PROJECTIONS = ("tic", "rms", "median", "base_peak", "peak_count", "mean_mz")
RAW_BIN_PPM = 50.0
#: Stretches of the range that a distribution function is summed in.
CDF_PARTS = 1000


def project(ds: MsiDataset, kind: str) -> DataFrame:
    """(dataset_id, pixel_id, value) of every pixel. Peak lists skip zeros in mean-like reductions;
    in a matrix the median and the root mean square count absent channels as 0."""
    if kind not in PROJECTIONS:
        raise ValueError(f"unknown projection {kind!r}")
    i = F.col("intensity").cast("double")
    if ds.is_matrix:
        n = ds.channels.groupBy("dataset_id").agg(F.count("*").alias("n"))
        values = ds.cells.join(ds.channels.select("dataset_id", "channel", "mz"), ["dataset_id", "channel"])
        sums = values.groupBy(*PIXEL).agg(F.sum(i).alias("s"), F.sum(i * i).alias("ss"), F.max(i).alias("top"), F.count("*").alias("k"), F.sum(F.col("mz") * i).alias("smz"), F.sort_array(F.collect_list(i)).alias("v")).join(n, "dataset_id")
        # The median of a row of n values of which n - k are 0.
        at = lambda r: F.when(r < F.col("n") - F.col("k"), 0.0).otherwise(F.get("v", (r - (F.col("n") - F.col("k"))).cast("int")))
        median = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
        expr = {"tic": F.col("s"), "rms": F.sqrt(F.col("ss") / F.col("n")), "median": median, "base_peak": F.col("top"), "peak_count": F.col("k").cast("double"), "mean_mz": F.try_divide("smz", "s")}[kind]
        out = sums.select(*PIXEL, expr.alias("value"))
    else:
        some = F.when(i > 0, i)
        expr = {"tic": F.sum(i), "rms": F.sqrt(F.avg(some * some)), "median": F.median(some), "base_peak": F.max(i), "peak_count": F.count("*").cast("double"), "mean_mz": F.try_divide(F.sum(F.col("mz") * i), F.sum(i))}[kind]
        out = ds.peaks.groupBy(*PIXEL).agg(expr.alias("value"))
    return ds.pixels.select(*PIXEL).join(out, PIXEL, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def per_pixel_reduce(peaks: DataFrame, kind: str) -> DataFrame:
    """(dataset_id, pixel_id, value) of the pixels that have peaks; mean, median and rms skip zeros."""
    i = F.col("intensity").cast("double")
    some = F.when(i > 0, i)
    agg = {"sum": F.sum(i), "max": F.max(i), "mean": F.avg(some), "median": F.median(some), "rms": F.sqrt(F.avg(some * some)), "count": F.count("*").cast("double")}[kind]
    return peaks.groupBy(*PIXEL).agg(F.coalesce(agg, F.lit(0.0)).alias("value"))


def projection_image(ds: MsiDataset, kind: str, fill: float = 0.0) -> DataFrame:
    return image(ds.pixels, project(ds, kind), ds.grid_shape, fill)


def contrast(values: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(dataset_id, low, high): percentiles of the values above 0; (0, 1) without any, and a range
    of one where they coincide."""
    q = values.groupBy("dataset_id").agg(F.percentile(F.when(F.col("value") > 0, F.col("value")), F.array(F.lit(lo), F.lit(hi))).alias("q"))
    a, b = F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("q", F.lit(1)), F.lit(1.0))
    return q.select("dataset_id", a.alias("low"), F.when(b > a, b).otherwise(a + 1.0).alias("high"))


def pixel_spectrum(ds: MsiDataset, x: int, y: int) -> DataFrame:
    """(dataset_id, mz, intensity) of the pixel at a coordinate: raw peaks, or non-zero channels."""
    at = ds.pixels.where((F.col("x") == x) & (F.col("y") == y)).select(*PIXEL)
    if ds.is_matrix:
        return ds.cells.join(at, PIXEL, "left_semi").join(ds.channels.select("dataset_id", "channel", "mz"), ["dataset_id", "channel"]).select("dataset_id", "mz", "intensity")
    return ds.peaks.join(at, PIXEL, "left_semi").select("dataset_id", "mz", "intensity")


def roi_matrix_spectrum(ds: MsiDataset, rois: list[RoiDef], method: str) -> DataFrame:
    """(dataset_id, channel, mz, value) over the pixels of the regions, zeros counted."""
    inside = roi_pixels(ds.pixels, *rois).select(*PIXEL)
    n = inside.groupBy("dataset_id").agg(F.count("*").alias("n"))
    i = F.col("intensity").cast("double")
    s = ds.cells.join(inside, PIXEL, "left_semi").groupBy("dataset_id", "channel").agg(F.sum(i).alias("s"), F.max(i).alias("top"), F.count("*").alias("k"), F.sort_array(F.collect_list(i)).alias("v")) if method == "median" else ds.cells.join(inside, PIXEL, "left_semi").groupBy("dataset_id", "channel").agg(F.sum(i).alias("s"), F.max(i).alias("top"))
    c = ds.channels.select("dataset_id", "channel", "mz").join(s, ["dataset_id", "channel"], "left").join(n, "dataset_id", "left")
    if method == "median":
        zeros = F.col("n") - F.col("k")
        at = lambda r: F.when(r < zeros, 0.0).otherwise(F.get("v", (r - zeros).cast("int")))
        value = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    else:
        value = {"mean": F.try_divide("s", "n"), "sum": F.col("s"), "max": F.col("top")}[method]
    return c.select("dataset_id", "channel", "mz", F.coalesce(value, F.lit(0.0)).alias("value"))


def roi_raw_spectrum(ds: MsiDataset, rois: list[RoiDef], method: str) -> DataFrame:
    """(dataset_id, bin, mz, value): 50-ppm bins of log m/z from the least m/z of the regions' peaks.

    ``median`` is the mean of a bin, as in the viewer this comes from; ``exact_median`` is the median."""
    inside = roi_pixels(ds.pixels, *rois).select(*PIXEL)
    p = ds.peaks.join(inside, PIXEL, "left_semi").where("intensity > 0").select("dataset_id", F.log("mz").alias("x"), F.col("intensity").cast("double").alias("i"))
    lo = p.groupBy("dataset_id").agg(F.min("x").alias("lo"))
    width = F.lit(RAW_BIN_PPM * 1e-6)
    p = p.join(lo, "dataset_id").withColumn("bin", F.floor((F.col("x") - F.col("lo")) / width).cast("bigint"))
    agg = {"sum": F.sum("i"), "max": F.max("i"), "mean": F.avg("i"), "median": F.avg("i"), "exact_median": F.median("i")}[method]
    return p.groupBy("dataset_id", "bin", "lo").agg(agg.alias("value")).select("dataset_id", "bin", F.exp(F.col("lo") + (F.col("bin") + 0.5) * width).alias("mz"), "value")


def channel_table(ds: MsiDataset) -> DataFrame:
    """(dataset_id, channel, mz, prevalence), the prevalence computed where it is missing."""
    n = ds.n_pixels()
    seen = ds.cells.where("intensity > 0").groupBy("dataset_id", "channel").agg(F.count("*").alias("k"))
    c = ds.channels.join(seen, ["dataset_id", "channel"], "left").join(n, "dataset_id")
    return c.select("dataset_id", "channel", "mz", F.coalesce("prevalence", F.coalesce("k", F.lit(0)) / F.col("n_pixels")).alias("prevalence"))


def top_channels(ds: MsiDataset, n: int) -> DataFrame:
    return channel_table(ds).orderBy(F.desc("prevalence"), F.desc("channel")).limit(n)


def nearest_channel(ds: MsiDataset, mz: float) -> DataFrame:
    return ds.channels.select("dataset_id", "channel", "mz").orderBy(F.abs(F.col("mz") - F.lit(float(mz))), "channel").limit(1)


def channel_image(ds: MsiDataset, channel: int) -> DataFrame:
    one = ds.cells.where(F.col("channel") == channel).select(*PIXEL, F.col("intensity").cast("double").alias("value"))
    return image(ds.pixels, one, ds.grid_shape)


def ion_image(ds: MsiDataset, mz: float, ppm: float) -> DataFrame:
    """The strongest peak in a window of m/z, as an image."""
    axis = ds.pixels.select("dataset_id").distinct().select("dataset_id", F.lit(0).alias("channel"), F.lit(float(mz)).alias("mz"), F.lit(mz * (1 - ppm * 1e-6)).alias("lo"), F.lit(mz * (1 + ppm * 1e-6)).alias("hi"))
    return image(ds.pixels, assign(ds.peaks, axis).groupBy(*PIXEL).agg(F.max("intensity").alias("value")), ds.grid_shape)


def _finite(values: DataFrame, col: str) -> DataFrame:
    """(v): the finite values, as doubles."""
    return values.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))).select(F.col(col).cast("double").alias("v"))


def cdf(values: DataFrame, col: str) -> DataFrame:
    """Distinct finite values with the share of values up to them, ranked by stretches of the range."""
    v = _finite(values, col).groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))
    span = v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))
    v = v.join(F.broadcast(span))  # one row is broadcast
    v = v.withColumn("part", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CDF_PARTS)).otherwise(0))
    below = v.groupBy("part").agg(F.sum("n").alias("here"))  # CDF_PARTS + 1 rows at most
    below = below.select("part", (F.sum("here").over(Window.orderBy("part")) - F.col("here")).alias("below"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return v.withColumn("upto", upto).join(F.broadcast(below), "part").select("value", ((F.col("upto") + F.col("below")) / F.col("total")).alias("share"))


def plotted_mz(*series: DataFrame) -> DataFrame:
    """(mz): the distinct m/z of all plotted series, ascending; a click snaps to the nearest of them."""
    every = functools.reduce(DataFrame.unionByName, (x.select(F.col("mz").cast("double").alias("mz")) for x in series))
    return every.where("mz IS NOT NULL").distinct().orderBy("mz")


def survivors(values: DataFrame, col: str, thresholds: list[float], current: float, above: bool = True) -> DataFrame:
    """(threshold, n, delta): how many values would stay, and how many more than now."""
    stays = (lambda at: F.col(col) >= at) if above else (lambda at: F.col(col) <= at)
    counts = values.agg(*(F.count_if(stays(F.lit(float(x)))).alias(f"n{k}") for k, x in enumerate(thresholds)), F.count_if(stays(F.lit(float(current)))).alias("now"))
    rows = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"n{k}").alias("n")) for k, x in enumerate(thresholds)))).alias("r")
    return counts.select(rows, "now").select("r.threshold", "r.n", (F.col("r.n") - F.col("now")).alias("delta"))


def histogram(values: DataFrame, col: str, bins: int | str) -> DataFrame:
    """(bin, left, right, n) over the range of the finite values; the last bin holds its right end.

    ``bins`` is a number, ``"sqrt"`` (the root of the number of values, from 8 to 50) or ``"integer"``
    (one bin an integer)."""
    v = _finite(values, col)
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("top"), F.count("*").alias("k")).where("lo IS NOT NULL")
    if bins == "integer":
        whole = lambda c: F.col(c).cast("bigint").cast("double")
        span = span.select(whole("lo").alias("lo"), (whole("top") + 1).alias("hi")).withColumn("bins", (F.col("hi") - F.col("lo")).cast("int"))
    else:
        count = F.least(F.lit(50), F.greatest(F.lit(8), F.floor(F.sqrt("k")))).cast("int") if bins == "sqrt" else F.lit(bins)
        span = span.select("lo", F.when(F.col("top") > F.col("lo"), F.col("top")).otherwise(F.col("lo") + 1.0).alias("hi"), count.alias("bins"))
    w = (F.col("hi") - F.col("lo")) / F.col("bins")
    edge = lambda k: F.when(k >= F.col("bins"), F.col("hi")).otherwise(F.col("lo") + k * w)
    v = v.join(F.broadcast(span))  # one row is broadcast
    # Rounding can put the quotient one bin off; the edges decide.
    k = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))))
    v = v.withColumn("k", k).withColumn("k", F.when(F.col("v") < edge(F.col("k")), F.col("k") - 1).when((F.col("k") < F.col("bins") - 1) & (F.col("v") >= edge(F.col("k") + 1)), F.col("k") + 1).otherwise(F.col("k")))
    n = v.groupBy(F.col("k").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = span.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(n, "bin", "left").select("bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))

"""Spatial autocorrelation of channel images: Moran's I with a permutation test.

The observed values are sums over joins. The permutations, the same for all channels, are keyed by
arithmetic on pixel numbers, so any task can make them: a task takes some channels' images and some
permutations, moves the images in memory, and returns counts. No row is made for a permuted cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_int
from ..functions.grid import QUEEN, ROOK, neighbours
from ..functions.stats import PRIME, bh, keyed
from ..model import DATASET, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, register
from .consensus import keep_channels, need_some


@dataclass(frozen=True)
class MoranParams:
    n_permutations: int = 499
    q_threshold: float = 0.05
    neighborhood: str = "queen"
    min_pixels_for_test: int = 64
    rng_seed: int = 0

    def __post_init__(self) -> None:
        if self.neighborhood not in ("queen", "rook"):
            raise ValueError("neighborhood must be queen or rook")


#: Values that a task holds at once (pixels times channels), permutations of one task, and the pixels of an
#: image beyond which permuted cells are rows, with the same result.
VALUES, REPS, IMAGE_PIXELS = 1 << 21, 128, 1 << 25


def permutations(pixels: DataFrame, n: int, seed: int) -> DataFrame:
    """(dataset_id, rep, pixel_id, to_id): the same permutations of pixels for every channel. Pixels in the
    order of their keys take the places of pixels in the order of their numbers."""
    r = pixels.select("dataset_id", "pixel_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    a, b = F.lit(1) + md5_int(seed, F.col("rep"), "a") % (PRIME - 1), md5_int(seed, F.col("rep"), "b") % PRIME
    r = r.withColumn("u", (F.col("pixel_id") % PRIME * a + b) % PRIME)
    key = (F.col("u") * F.col("u") % PRIME * F.col("u") + F.col("pixel_id")) % PRIME
    by = Window.partitionBy("dataset_id", "rep")
    shuffled = r.withColumn("k", F.row_number().over(by.orderBy(key, "pixel_id")))
    plain = r.withColumn("k", F.row_number().over(by.orderBy("pixel_id"))).withColumnRenamed("pixel_id", "to_id")
    return shuffled.join(plain, ["dataset_id", "rep", "k"]).select("dataset_id", "rep", "pixel_id", "to_id")


def order(pixel_ids: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """The places in ascending ``pixel_ids`` of the pixels in the order of their keys."""
    return np.argsort(keyed(pixel_ids, rep, seed), kind="stable")


def edge_places(gx: np.ndarray, gy: np.ndarray, offsets) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbours by their places, each pair once: half of the offsets has them all."""
    width = int(gx.max()) - int(gx.min()) + 3
    at = (gy - gy.min()).astype(np.int64) * width + (gx - gx.min()) + 1
    by = np.argsort(at, kind="stable")
    out = []
    for dy, dx in offsets:
        if (dy, dx) > (0, 0):
            to = at + dy * width + dx
            k = np.minimum(np.searchsorted(at[by], to), len(at) - 1)
            found = at[by][k] == to
            out.append((np.flatnonzero(found), by[k[found]]))
    return out


def count_as_large(pixel_ids, gx, gy, images: np.ndarray, observed: np.ndarray, offsets, reps, seed: int) -> np.ndarray:
    """How many of the permutations give each image (a column of ``images``) an I of at least the observed size."""
    n = len(pixel_ids)
    z = images - images.mean(axis=0)
    var = (z * z).sum(axis=0)
    flat = var <= 1e-12 * (images * images).sum(axis=0)
    pairs = edge_places(gx, gy, offsets)
    s0 = 2 * sum(len(a) for a, _ in pairs)
    counts = np.zeros(images.shape[1], np.int64)
    for rep in reps:
        moved = z[order(pixel_ids, rep, seed)]
        cross = sum(np.einsum("ij,ij->j", moved[a], moved[b]) for a, b in pairs)
        with np.errstate(divide="ignore", invalid="ignore"):
            i = np.where(flat | (s0 == 0), 0.0, 2 * n * cross / (s0 * var))
        counts += np.abs(i) >= np.abs(observed) - 1e-12
    return counts


def null_counts(cells: DataFrame, seen: DataFrame, pixels: DataFrame, p: MoranParams, seed: int, block: int) -> DataFrame:
    """(dataset_id, channel, k): as :func:`count_as_large`, for ``seen`` (dataset_id, channel, i).

    A group is the pixels of a dataset with the cells of ``block`` channels, for ``REPS`` permutations."""
    offsets, n = QUEEN if p.neighborhood == "queen" else ROOK, p.n_permutations
    starts = F.explode(F.array(*(F.lit(k) for k in range(0, n, REPS)))).alias("rep")
    channels = seen.select("dataset_id", "channel", "i", F.floor(F.col("channel") / block).cast("int").alias("block"))
    # Three kinds of rows in a group: channels with their observed value, pixels with their place, cells.
    none = F.lit(None)
    heads = channels.select("dataset_id", "block", starts, "channel", none.cast("bigint").alias("pixel_id"), none.cast("int").alias("gx"), none.cast("int").alias("gy"), F.col("i").alias("x"))
    blocks = channels.select("dataset_id", "block").distinct()
    places = pixels.join(blocks, "dataset_id").select("dataset_id", "block", starts, none.cast("int").alias("channel"), "pixel_id", "gx", "gy", none.cast("double").alias("x"))
    values = cells.select("dataset_id", F.floor(F.col("channel") / block).cast("int").alias("block"), starts, F.col("channel").cast("int").alias("channel"), "pixel_id", none.cast("int").alias("gx"), none.cast("int").alias("gy"), F.col("intensity").cast("double").alias("x"))
    rows = heads.withColumn("channel", F.col("channel").cast("int")).unionByName(places).unionByName(values)

    schema = pa.schema([("dataset_id", pa.string()), ("channel", pa.int32()), ("k", pa.int64())])

    def run(key, t):
        name, _, first = (k.as_py() for k in key)
        t = t.select(["channel", "pixel_id", "gx", "gy", "x"])
        channel, pixel, gx, gy, x = (t.column(k) for k in range(5))
        is_pixel, is_head = channel.is_null().to_numpy(), pixel.is_null().to_numpy()
        if not is_pixel.any() or not is_head.any():
            return schema.empty_table()
        ids = pixel.filter(pa.array(is_pixel)).to_numpy()
        by = np.argsort(ids, kind="stable")
        ids, gx, gy = ids[by], gx.filter(pa.array(is_pixel)).to_numpy()[by], gy.filter(pa.array(is_pixel)).to_numpy()[by]
        chans = channel.filter(pa.array(is_head)).to_numpy()
        up = np.argsort(chans)
        chans, observed = chans[up], x.filter(pa.array(is_head)).to_numpy()[up]
        cell = pa.array(~is_pixel & ~is_head)
        images = np.zeros((len(ids), len(chans)))
        images[np.searchsorted(ids, pixel.filter(cell).to_numpy()), np.searchsorted(chans, channel.filter(cell).to_numpy())] = x.filter(cell).to_numpy()
        k = count_as_large(ids, gx, gy, images, observed, offsets, range(first, min(first + REPS, n)), seed)
        return pa.table([pa.array([name] * len(chans), pa.string()), pa.array(chans, pa.int32()), pa.array(k)], schema=schema)

    counts = rows.groupBy("dataset_id", "block", "rep").applyInArrow(run, "dataset_id string, channel int, k bigint")
    return counts.groupBy("dataset_id", "channel").agg(F.sum("k").alias("k"))


def moran(cells: DataFrame, edges: DataFrame, n_pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i): Moran's I of each group of non-zero cells (keys, pixel_id, intensity), ``keys`` holding dataset_id.

    Only non-zero cells and the pixels' degrees enter: with mean m over n pixels the numerator is
    sum over edges x_i x_j - 2 m sum degree_i x_i + m^2 S0, the denominator sum x^2 - n m^2.
    """
    degree = edges.groupBy("dataset_id", "pixel_id").agg(F.count("*").alias("degree"))
    s0 = edges.groupBy("dataset_id").agg(F.count("*").alias("s0"))
    x = cells.select(*keys, "pixel_id", F.col("intensity").cast("double").alias("x"))
    sums = x.join(degree, ["dataset_id", "pixel_id"], "left").groupBy(*keys).agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.coalesce("degree", F.lit(0))).alias("sdx"))
    other = x.withColumnRenamed("pixel_id", "neighbour_id").withColumnRenamed("x", "y")
    cross = x.join(edges, ["dataset_id", "pixel_id"]).join(other, [*keys, "neighbour_id"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    t = sums.join(cross, keys, "left").join(n_pixels, DATASET).join(s0, DATASET, "left")
    m = F.col("sx") / F.col("n_pixels")
    num = F.coalesce("sxy", F.lit(0.0)) - 2 * m * F.col("sdx") + m * m * F.col("s0")
    var = F.col("sxx") - F.col("n_pixels") * m * m
    # A constant image has no variance but rounding; its I is 0.
    i = F.when(var <= 1e-12 * F.col("sxx"), 0.0).otherwise(F.try_divide(F.col("n_pixels") * num, F.col("s0") * var))
    return t.select(*keys, F.coalesce(i, F.lit(0.0)).alias("i"))


def moran_test(cells: DataFrame, channels: DataFrame, pixels: DataFrame, p: MoranParams, seed: int = 0) -> DataFrame:
    """``channels`` with i, p, q and kept (two-sided on |I|)."""
    edges = neighbours(pixels, QUEEN if p.neighborhood == "queen" else ROOK)
    n = pixels.groupBy("dataset_id").agg(F.count("*").alias("n_pixels"))
    seen = channels.join(moran(cells, edges, n, ["dataset_id", "channel"]), ["dataset_id", "channel"], "left").withColumn("i", F.coalesce("i", F.lit(0.0)))
    most = n.agg(F.max("n_pixels")).first()[0] or 1
    if most <= IMAGE_PIXELS:
        more = null_counts(cells, hold(seen.select("dataset_id", "channel", "i")), pixels, p, seed, max(1, VALUES // most))
    else:
        moved = cells.join(permutations(pixels, p.n_permutations, seed), ["dataset_id", "pixel_id"]).select("dataset_id", "channel", "rep", F.col("to_id").alias("pixel_id"), "intensity")
        null = moran(moved, edges, n, ["dataset_id", "channel", "rep"])
        more = null.withColumnRenamed("i", "i0").join(seen.select("dataset_id", "channel", "i"), ["dataset_id", "channel"]).groupBy("dataset_id", "channel").agg(F.count_if(F.abs("i0") >= F.abs("i") - 1e-12).alias("k"))
    # An empty channel has I = 0 under every permutation too.
    t = seen.join(more, ["dataset_id", "channel"], "left").withColumn("p", (F.coalesce("k", F.lit(p.n_permutations)) + 1) / F.lit(p.n_permutations + 1.0)).drop("k")
    s0 = edges.groupBy("dataset_id").agg(F.count("*").alias("s0"))
    t = bh(t).join(n, DATASET).join(s0, DATASET, "left")
    return t.withColumn("kept", (F.col("n_pixels") < p.min_pixels_for_test) | F.col("s0").isNull() | (F.col("q") < p.q_threshold)).drop("n_pixels", "s0")


@register
class MoransI(Operator):
    name = "morans_i_permutation"
    params_cls = MoranParams

    def run(self, ds: MsiDataset, params: MoranParams, seed: int) -> OpResult:
        cells = ds.need_cells(self.name)
        t = moran_test(cells, ds.channels, ds.pixels, params, seed)
        cells, channels = keep_channels(cells, t.select(*ds.channels.columns, "kept"), F.col("kept"))
        if not ds.channels.isEmpty():
            need_some(channels, f"no channel has q < {params.q_threshold}")
        summary = t.agg(F.count("*").cast("double").alias("n_channels_in"), F.count_if("kept").cast("double").alias("n_channels_out"), F.count_if(~F.col("kept")).cast("double").alias("n_dropped_by_fdr"), F.min("i").alias("I_min"), F.median("i").alias("I_median"), F.max("i").alias("I_max"), F.min("q").alias("q_value_min"), F.median("q").alias("q_value_median"), *numbers(n_permutations=params.n_permutations, q_threshold=params.q_threshold))
        return OpResult(ds.with_matrix(cells, channels.drop("kept")).with_extras(morans_i=t), (Diagnostic(self.name, summary, {"test": t}, "scatter:i_vs_q"),))

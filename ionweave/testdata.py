"""Adapter views: the driver's tables as peaks, pixels, cells and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ExperimentParams, MsiDataset, RoiDef, pixels_of

ONE = "all"
FG = RoiDef("sample", ((0, 0), (0, 7.5), (7.5, 7.5), (7.5, 0)))
BG = RoiDef("slide", ((10, 10), (10, 15.5), (15.5, 15.5), (15.5, 10)), True)


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _grid(spark: SparkSession, n: int, width: int, height: int, ids: DataFrame) -> DataFrame:
    p = spark.range(n).select(F.col("id").alias("pixel_id"), (F.col("id") % width + 1).cast("int").alias("x"), (F.floor(F.col("id") / width) + 1).cast("int").alias("y"))
    return p.join(ids)


def peaks_dataset(spark: SparkSession, sf_dir: str, cohort: bool = False) -> MsiDataset:
    """256 pixels on 16 x 16 with 50 planted m/z from 210 to 700; three datasets with ``cohort``."""
    line = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    mz = (200 + 10 * F.col("p_size")) * (1 + ((F.col("l_orderkey") % 21) - 10) * F.lit(1e-6))
    name = F.col("l_returnflag") if cohort else F.lit(ONE)
    peaks = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(name.alias("dataset_id"), (F.col("l_orderkey") % 256).alias("pixel_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("peak_idx"), mz.alias("mz"), F.col("l_extendedprice").alias("intensity"))
    ids = spark.createDataFrame([(x,) for x in (("A", "N", "R") if cohort else (ONE,))], "dataset_id string")
    pixels, shape = pixels_of(_grid(spark, 256, 16, 16, ids), (16, 16))
    return MsiDataset(pixels, peaks=peaks, grid_shape=shape, metadata=ExperimentParams("tof_reflectron", "maldi", "centroided", "positive", 200.0, 710.0), rois=(FG, BG))


def cells_dataset(spark: SparkSession, sf_dir: str) -> MsiDataset:
    """64 channels of the embeddings' positive parts on a grid of width 25; peak counts are twice the cells."""
    emb = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cells = emb.select(F.lit(ONE).alias("dataset_id"), F.col("vec_id").alias("pixel_id"), F.posexplode("embedding").alias("channel", "v"))
    cells = cells.select("dataset_id", "pixel_id", "channel", F.col("v").cast("double").alias("intensity")).where("intensity > 0")
    coords = emb.select(F.lit(ONE).alias("dataset_id"), F.col("vec_id").alias("pixel_id"), (F.col("vec_id") % 25 + 1).cast("int").alias("x"), (F.floor(F.col("vec_id") / 25) + 1).cast("int").alias("y"))
    pixels, shape = pixels_of(coords)
    n = pixels.groupBy("dataset_id").agg(F.count("*").alias("n_pixels"))
    ch = cells.groupBy("dataset_id", "channel").agg(F.count("*").alias("k")).join(n, "dataset_id")
    channels = ch.select("dataset_id", "channel", (100.0 + F.col("channel")).alias("mz"), (F.col("k") / F.col("n_pixels")).alias("prevalence"), (F.col("k") * 2).alias("n_peaks"))
    return MsiDataset(pixels, cells=cells, channels=channels, grid_shape=shape, rois=(FG, BG))


def profile_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return emb.select(F.lit(ONE).alias("dataset_id"), F.col("vec_id").alias("pixel_id"), F.transform("embedding", lambda _, i: 200.0 * F.pow(F.lit(1 + 20e-6), i.cast("double"))).alias("mz"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intensity"))


def sparse_peaks(spark: SparkSession, sf_dir: str) -> MsiDataset:
    """Irregular m/z from the events: pixel by user, m/z = 100 + value."""
    ev = _table(spark, sf_dir, "events", "event_id", "user_id", "value")
    peaks = ev.select(F.lit(ONE).alias("dataset_id"), F.col("user_id").alias("pixel_id"), F.col("event_id").alias("peak_idx"), (100.0 + F.col("value")).alias("mz"), F.col("value").alias("intensity"))
    ids = peaks.select("dataset_id", "pixel_id").distinct()
    pixels, shape = pixels_of(ids.select("dataset_id", "pixel_id", (F.col("pixel_id") % 16 + 1).cast("int").alias("x"), (F.floor(F.col("pixel_id") / 16) + 1).cast("int").alias("y")))
    return MsiDataset(pixels, peaks=peaks, grid_shape=shape)

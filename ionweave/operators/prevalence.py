"""Channels whose prevalence exceeds chance: occupancy of pixels by the channel's peaks."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import md5_int
from ..functions.stats import bh, occupancy_tail
from ..model import DATASET, MsiDataset, hold
from .base import Diagnostic, Operator, OpResult, numbers, register
from .consensus import keep_channels, need_some


@dataclass(frozen=True)
class PrevalenceFdrParams:
    """``method``: ``exact`` computes the tail, ``draws`` estimates it by keyed draws."""

    n_permutations: int = 499
    q_threshold: float = 0.05
    min_pixels_for_test: int = 64
    rng_seed: int = 0
    method: str = "exact"


def observed(cells: DataFrame, channels: DataFrame, n_pixels: DataFrame) -> DataFrame:
    """(dataset_id, channel, mz, prevalence, n_peaks, n_pixels, obs, balls, assumed): ``balls`` falls back
    to the observed count where the number of peaks is not known."""
    obs = cells.where("intensity > 0").groupBy("dataset_id", "channel").agg(F.count("*").alias("obs"))
    c = channels.join(obs, ["dataset_id", "channel"], "left").join(n_pixels, DATASET).withColumn("obs", F.coalesce("obs", F.lit(0)).cast("bigint"))
    return c.withColumn("balls", F.coalesce("n_peaks", "obs").cast("bigint")).withColumn("assumed", F.col("n_peaks").isNull())


@F.pandas_udf(T.DoubleType())
def _tail(n: pd.Series, k: pd.Series, obs: pd.Series) -> pd.Series:
    return pd.Series([occupancy_tail(int(a), int(b), int(c)) for a, b, c in zip(n, k, obs, strict=True)], dtype="float64")


def p_exact(c: DataFrame) -> DataFrame:
    """The tail once for each distinct (pixels, peaks, observed)."""
    key = ["n_pixels", "balls", "obs"]
    return c.join(c.select(*key).distinct().repartition(*key).withColumn("p", _tail(*key)), key)


#: Balls of one draw that a row throws, balls made at once from a row, and balls for which there is a task.
THROWS, STEP, TASK = 1 << 24, 1 << 12, 1 << 18
#: Longs of a bitmap of pixels, and the most tasks that throw balls.
LONGS, MOST_TASKS = 16, 4096


def filled(c: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(dataset_id, channel, rep, obs, full): the pixels that each draw fills.

    Draws are dealt to tasks before their balls are made. A ball is a bit of a bitmap that its task updates,
    so a task holds and shuffles bits of pixels, and no row for a ball."""
    total = c.agg(F.sum("balls")).first()[0] or 0
    long = lambda v: F.lit(v).cast("bigint")
    d = c.where("balls > 0").select("dataset_id", "channel", "n_pixels", "obs", "balls", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("rep"))
    d = d.withColumn("start", F.explode(F.sequence(long(1), F.col("balls"), long(THROWS))))
    d = d.repartition(min(MOST_TASKS, total * n_draws // TASK + 1), "dataset_id", "channel", "rep", "start")
    d = d.withColumn("last", F.least(F.col("start") + THROWS - 1, "balls")).withColumn("at", F.explode(F.sequence("start", "last", long(STEP))))
    d = d.withColumn("ball", F.explode(F.sequence("at", F.least(F.col("at") + STEP - 1, "last"))))
    d = d.select("dataset_id", "channel", "rep", "obs", F.pmod(md5_int(seed, F.col("rep"), F.col("channel"), F.col("ball")), F.col("n_pixels")).alias("pixel"))
    bit, word = F.expr("shiftleft(1L, cast(pixel & 63 as int))"), F.shiftright("pixel", 6) % LONGS
    d = d.select("dataset_id", "channel", "rep", "obs", F.floor(F.col("pixel") / (64 * LONGS)).alias("block"), word.alias("word"), bit.alias("bit"))
    maps = d.groupBy("dataset_id", "channel", "rep", "obs", "block").agg(*(F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(long(0))).alias(f"b{k}") for k in range(LONGS)))
    return maps.groupBy("dataset_id", "channel", "rep", "obs").agg(F.sum(sum((F.bit_count(f"b{k}") for k in range(LONGS)), F.lit(0))).alias("full"))


def p_draws(c: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(#draws at least as full + 1) / (draws + 1), each ball keyed by (seed, draw, channel, ball)."""
    c = hold(c)
    p = filled(c, n_draws, seed).groupBy("dataset_id", "channel").agg(((F.count_if(F.col("full") >= F.col("obs")) + 1) / F.lit(n_draws + 1.0)).alias("p"))
    return c.join(p, ["dataset_id", "channel"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))


def prevalence_test(cells: DataFrame, channels: DataFrame, n_pixels: DataFrame, p: PrevalenceFdrParams, seed: int = 0) -> DataFrame:
    """``channels`` with obs, p, q and kept; datasets of too few pixels keep all."""
    c = observed(cells, channels, n_pixels)
    c = bh(p_exact(c) if p.method == "exact" else p_draws(c, p.n_permutations, seed))
    return c.withColumn("kept", (F.col("n_pixels") < p.min_pixels_for_test) | (F.col("q") < p.q_threshold))


@register
class PrevalenceFdrFilter(Operator):
    name = "prevalence_fdr_filter"
    params_cls = PrevalenceFdrParams

    def run(self, ds: MsiDataset, params: PrevalenceFdrParams, seed: int) -> OpResult:
        cells = ds.need_cells(self.name)
        t = prevalence_test(cells, ds.channels, ds.n_pixels(), params, seed)
        cells, channels = keep_channels(cells, t.select(*ds.channels.columns, "kept"), F.col("kept"))
        if not ds.channels.isEmpty():
            need_some(channels, f"no channel has q < {params.q_threshold}")
        summary = t.agg(F.count("*").cast("double").alias("n_channels_in"), F.count_if("kept").cast("double").alias("n_channels_out"), F.count_if(~F.col("kept")).cast("double").alias("n_dropped_by_fdr"), F.min("p").alias("p_value_min"), F.median("p").alias("p_value_median"), F.min("q").alias("q_value_min"), F.median("q").alias("q_value_median"), F.max(F.col("assumed").cast("double")).alias("warning_conservative_fallback"), *numbers(n_permutations=params.n_permutations, q_threshold=params.q_threshold))
        return OpResult(ds.with_matrix(cells, channels.drop("kept")).with_extras(prevalence_fdr=t), (Diagnostic(self.name, summary, {"test": t}, "histogram:q"),))

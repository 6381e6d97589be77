"""Joins of peaks to an axis of channels, as bucketed equi-joins (no nested loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in the logarithm of m/z.
BUCKET = 0.002


def bucket(mz):
    return F.floor(F.log(mz) / F.lit(BUCKET)).cast("bigint")


def assign(peaks: DataFrame, axis: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Peaks with each channel whose window holds them, of the two channels nearest on either side.

    ``axis``: (keys, channel, mz, lo, hi). Adds ``channel``; a peak between two overlapping windows
    comes twice. A channel's window is laid over the buckets that it touches.
    """
    on = ["dataset_id"] if on is None else on
    by = Window.partitionBy(*on).orderBy("mz")  # over channels, not peaks
    c = axis.select(*on, "channel", F.col("mz").alias("c_mz"), "lo", "hi", F.lag("mz").over(by).alias("c_before"), F.lead("mz").over(by).alias("c_after"))
    c = c.withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    m = F.col("mz")
    right = (m <= F.col("c_mz")) & (F.col("c_before").isNull() | (m > F.col("c_before")))
    left = (m > F.col("c_mz")) & (F.col("c_after").isNull() | (m <= F.col("c_after")))
    got = peaks.withColumn("b", bucket(m)).join(c, [*on, "b"]).where((m >= F.col("lo")) & (m <= F.col("hi")) & (left | right))
    return got.drop("b", "c_before", "c_after", "lo", "hi")


def nearest(peaks: DataFrame, axis: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Peaks with the nearest channel; ties go to the left one.

    Each channel owns the half-open slot up to the next one; the slot is laid over buckets.
    """
    on = ["dataset_id"] if on is None else on
    by = Window.partitionBy(*on).orderBy("mz")
    c = axis.select(*on, "channel", F.col("mz").alias("c_mz"), F.lag("mz").over(by).alias("before"), F.lead("mz").over(by).alias("after"))
    # A peak m belongs to c if (before + c) / 2 < m <= (c + after) / 2.
    c = c.select(*on, "channel", "c_mz", ((F.col("before") + F.col("c_mz")) / 2).alias("lo"), ((F.col("c_mz") + F.col("after")) / 2).alias("hi"))
    span = peaks.groupBy(*on).agg(F.min("mz").alias("least"), F.max("mz").alias("most"))
    c = c.join(span, on)
    c = c.withColumn("b", F.explode(F.sequence(bucket(F.least(F.coalesce("lo", "least"), F.coalesce("hi", "most"))), bucket(F.greatest(F.coalesce("hi", "most"), F.coalesce("lo", "least"))))))
    m = F.col("mz")
    inside = (F.col("lo").isNull() | (m > F.col("lo"))) & (F.col("hi").isNull() | (m <= F.col("hi")))
    return peaks.withColumn("b", bucket(m)).join(c, [*on, "b"]).where(inside).drop("b", "lo", "hi", "least", "most")


def numbered(axis: DataFrame, on: list[str] | None = None) -> DataFrame:
    """``channel`` counted from 0 by ascending m/z."""
    on = ["dataset_id"] if on is None else on
    return axis.withColumn("channel", (F.row_number().over(Window.partitionBy(*on).orderBy("mz")) - 1).cast("int"))

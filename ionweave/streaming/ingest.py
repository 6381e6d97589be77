"""Incremental ingestion of acquisitions: new peak files are projected and stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PEAKS, PIXEL


def tic_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table (dataset_id, pixel_id, tic, peaks) over Parquet peak files of a folder."""
    peaks = spark.readStream.schema(PEAKS).parquet(folder)
    return peaks.groupBy(*PIXEL).agg(F.sum("intensity").alias("tic"), F.count("*").alias("peaks"))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Append what is new in ``folder`` to the peaks table at ``table``, partitioned by dataset; each file
    is taken once, whatever fails in between."""
    peaks = spark.readStream.schema(PEAKS).parquet(folder)
    q = peaks.writeStream.format("parquet").partitionBy("dataset_id").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_tic(spark: SparkSession, folder: str, out: str, checkpoint: str) -> DataFrame:
    """Bring the projection at ``out`` up to date and return it: one row a pixel, the newest one."""
    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = tic_stream(spark, folder).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    seen = spark.read.schema("dataset_id string, pixel_id bigint, tic double, peaks bigint, epoch bigint").parquet(out)
    return seen.groupBy(*PIXEL).agg(F.max_by(F.struct("tic", "peaks"), "epoch").alias("s")).select(*PIXEL, "s.tic", "s.peaks")

"""What the jobs share: config files, peak tables of any columns, partitioned output, logging."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.model import shared_dir

#: The columns that a config's ``columns`` give, as SQL expressions over the input's columns.
PEAK_TYPES = {"dataset_id": "string", "pixel_id": "bigint", "peak_idx": "bigint", "mz": "double", "intensity": "double"}
#: The dataset of rows that name none.
UNNAMED = "unnamed"


def config_of(job_file: str, spark: SparkSession | None = None, path: str | None = None) -> dict:
    """The config beside a job's module, with the values of the file at ``path`` over it."""
    config = json.loads(Path(job_file).with_suffix(".json").read_text())
    if path:
        config |= json.loads(spark.read.text(path, wholetext=True).first()[0])
    return config


def peaks_of(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Peaks (dataset_id, pixel_id, peak_idx, mz, intensity) of an input table. What has no pixel, no
    positive m/z or no intensity of 0 or more isn't a peak and is left out."""
    made = rows.select(*(F.expr(columns[c]).cast(t).alias(c) for c, t in PEAK_TYPES.items()))
    made = made.withColumns({"dataset_id": F.coalesce(F.nullif("dataset_id", F.lit("")), F.lit(UNNAMED)), "peak_idx": F.coalesce("peak_idx", F.lit(0))})
    return made.where("pixel_id IS NOT NULL AND mz > 0 AND mz < double('Infinity') AND intensity >= 0 AND intensity < double('Infinity')")


def write_by_dataset(df: DataFrame, path: str, *more: str) -> None:
    """Replace the partitions of the datasets in ``df`` and leave all others. Large datasets are
    split over tasks by the rebalancing of adaptive execution."""
    df.hint("rebalance", "dataset_id").write.partitionBy("dataset_id", *more).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written, asked of the path's own file system."""
    p, files = _file(spark, path)
    return files.exists(p)


def folder_of(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """What a file stream watches: a folder, or for a single file its folder and an option that names it."""
    p, files = _file(spark, path)
    return (p.getParent().toString(), {"pathGlobFilter": p.getName()}) if files.isFile(p) else (path, {})


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def command_line(doc: str, job_file: str, run: Callable[[SparkSession, str, str, dict], object], argv: list[str] | None = None) -> int:
    """INPUT OUTPUT [--config FILE]: creates the session, runs the job and stops the session."""
    p = argparse.ArgumentParser(description=doc.strip().splitlines()[0])
    p.add_argument("input", help="a file or folder that Spark reads")
    p.add_argument("output", help="a folder, local or remote")
    p.add_argument("--config", help="a JSON file whose values replace those of the job's own")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(Path(job_file).stem).getOrCreate()
    try:
        run(spark, args.input, args.output, config_of(job_file, spark, args.config))
    finally:
        spark.stop()
    return 0

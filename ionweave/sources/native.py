"""Saved datasets: Parquet tables with the metadata, regions and lineage beside them."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import PIXEL, DatasetIdentity, ExperimentParams, MsiDataset, OpRecord, RoiDef
from . import files

ABOUT = "about.json"
TABLES = ("pixels", "peaks", "cells", "channels")


def _write(df: DataFrame, path: str) -> None:
    """Rows of a pixel lie together, and statistics of row groups let a reader skip others."""
    keys = [c for c in PIXEL if c in df.columns]
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(path)


def write(ds: MsiDataset, folder: str) -> None:
    """Save ``ds`` as ``folder``, which any file system of Spark may hold.

    All is written to a new folder, which then takes the place of an old one of that name: a dataset can
    be saved over the one that it was read from, and a writer that dies leaves the old one."""
    spark, final = ds.pixels.sparkSession, folder.rstrip("/")
    head, _, name = final.rpartition("/")
    aside = lambda what: f"{head}/.{name}-{what}-{uuid.uuid4().hex}" if head else f".{name}-{what}-{uuid.uuid4().hex}"
    folder, old = aside("new"), aside("old")
    tables = [t for t in TABLES if getattr(ds, t) is not None]
    for t in tables:
        _write(getattr(ds, t), f"{folder}/{t}")
    for name, df in ds.extras.items():
        _write(df, f"{folder}/extras-{name}")
    about = {
        "tables": tables, "extras": list(ds.extras), "grid_shape": list(ds.grid_shape), "metadata": dataclasses.asdict(ds.metadata), "sources": dict(ds.sources),
        "identity": dataclasses.asdict(ds.identity), "history": [dataclasses.asdict(h) for h in ds.history], "rois": [dataclasses.asdict(r) for r in ds.rois], "rng_seed": ds.rng_seed,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{ABOUT}")
    replaces = files.spark_exists(spark, final) and files.spark_rename(spark, final, old)
    if not files.spark_rename(spark, folder, final):
        raise RuntimeError(f"{final} was written by another session meanwhile")
    if replaces:
        files.spark_delete(spark, old)


def read(spark: SparkSession, folder: str) -> MsiDataset:
    """A dataset that :func:`write` saved."""
    about = json.loads(spark.read.text(f"{folder}/{ABOUT}").first()[0])
    pairs = lambda xs: tuple(map(tuple, xs))
    identity = about["identity"] | {"extra": pairs(about["identity"]["extra"])}
    return MsiDataset(
        **{t: spark.read.parquet(f"{folder}/{t}") for t in about["tables"]}, grid_shape=tuple(about["grid_shape"]), metadata=ExperimentParams(**about["metadata"]), sources=about["sources"],
        identity=DatasetIdentity(**identity), history=tuple(OpRecord(**{**h, "summary": pairs(h["summary"])}) for h in about["history"]), rng_seed=about["rng_seed"],
        rois=tuple(RoiDef(r["name"], pairs(r["vertices"]), r["is_background"]) for r in about["rois"]), extras={n: spark.read.parquet(f"{folder}/extras-{n}") for n in about["extras"]},
    )

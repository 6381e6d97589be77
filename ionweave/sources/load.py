"""Readers by the look of a path, and folders of datasets."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import SparkSession

from ..model import MsiDataset
from . import files, native, spec
from .andi import read_cdf, read_cdf_image
from .imzml import read_imzml


def load(spark: SparkSession, path: str, dataset_id: str | None = None) -> MsiDataset | spec.Spec:
    """An imzML pair, an ANDI-MS file, a folder of ANDI-MS lines, a saved dataset, or a manifest."""
    low = path.lower()
    if low.endswith(".spec.xml"):
        return spec.read(path)
    if files.spark_exists(spark, f"{path}/{native.ABOUT}"):
        return native.read(spark, path)
    if os.path.isdir(path):
        return read_cdf_image(spark, path, dataset_id=dataset_id)
    if low.endswith((".imzml", ".ibd")):
        return read_imzml(spark, path, dataset_id)
    if low.endswith((".cdf", ".nc")):
        return read_cdf(spark, path, dataset_id)
    raise ValueError(f"no reader for {path}")


def find(root: str, pattern: str = "*.imzML", recursive: bool = False) -> list[str]:
    """Matching files below ``root``, sorted."""
    out = []
    for folder, subs, files in os.walk(root):
        out += [os.path.join(folder, f) for f in files if fnmatch.fnmatch(f.lower(), pattern.lower())]
        if not recursive:
            break
    return sorted(out)


def load_cohort(spark: SparkSession, root: str, pattern: str = "*.imzML", recursive: bool = False) -> list[MsiDataset]:
    paths = find(root, pattern, recursive)
    if not paths:
        raise FileNotFoundError(f"nothing in {root} matches {pattern}")
    return [load(spark, p, os.path.splitext(os.path.relpath(p, root))[0]) for p in paths]

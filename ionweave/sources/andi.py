"""ANDI-MS files: a single run as a row of pixels, or a folder of runs as the lines of an image."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PEAKS, DatasetIdentity, MsiDataset, pixels_of, sha256_file
from . import netcdf3, sidecar

#: Scans that one task reads, about.
SCANS = 2000


@dataclass(frozen=True)
class CdfLayout:
    """Files in image order, scans of each, and which axis the files run along."""

    files: tuple[str, ...]
    scans: tuple[int, ...]
    axis_along_files: str = "y"
    serpentine: bool = False

    @property
    def scans_per_line(self) -> int:
        return min(self.scans)


def header(path: str) -> netcdf3.Header:
    with open(path, "rb") as f:
        return netcdf3.read_header(f)


def metadata(h: netcdf3.Header, image: bool) -> dict[str, Any]:
    """What the attributes tell: electrospray of an image is taken for desorption electrospray."""
    text = {k: str(v).lower() for k, v in h.attrs.items()}
    ion = text.get("test_ionization_mode", "")
    out: dict[str, Any] = {}
    if "electrospray" in ion:
        out["ionization"] = "desi" if image else "esi"
    elif "maldi" in ion or "laser" in ion:
        out["ionization"] = "maldi"
    pol = text.get("test_ionization_polarity", "")
    out |= {"polarity": p for p in ("negative", "positive") if p in pol}
    kind = text.get("experiment_type", "")
    out |= {"profile_or_centroided": v for k, v in (("continuum", "profile"), ("profile", "profile"), ("centroid", "centroided")) if k in kind}
    inst = " ".join(v for k, v in text.items() if "instrument" in k or "detector" in k)
    for word, family in (("orbitrap", "orbitrap"), ("ft-icr", "fticr"), ("fticr", "fticr"), ("q-tof", "qtof"), ("qtof", "qtof"), ("reflectron", "tof_reflectron"), ("tof", "tof_axial")):
        if word in inst:
            out["instrument_family"] = family
            break
    return out


def scan_bounds(path: str, h: netcdf3.Header) -> tuple[float, float]:
    with open(path, "rb") as f:
        lo = netcdf3.read_variable(f, h, "mass_range_min") if "mass_range_min" in h.variables else np.zeros(0)
        hi = netcdf3.read_variable(f, h, "mass_range_max") if "mass_range_max" in h.variables else np.zeros(0)
        if not len(lo) or not len(hi):
            v = netcdf3.read_variable(f, h, "mass_values")
            return (float(v.min()), float(v.max())) if len(v) else (0.0, 1.0)
    return float(lo.min()), float(hi.max())


def peaks_of(spark: SparkSession, jobs: list[tuple[str, int, int, int, int]], dataset_id: str) -> DataFrame:
    """Peaks of runs of scans (path, first scan, scans, first pixel, pixel step): one run a task, read by seeks."""
    def run(batches):
        for batch in batches:
            for path, first, n, px, by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as f:
                    h = netcdf3.read_header(f)
                    at = netcdf3.read_variable(f, h, "scan_index", first, first + n).astype(np.int64)
                    k = netcdf3.read_variable(f, h, "point_count", first, first + n).astype(np.int64)
                    if not len(at):
                        continue
                    lo, hi = int(at[0]), int((at + k).max())
                    mz, inten = (netcdf3.read_variable(f, h, v, lo, hi).astype(np.float64) for v in ("mass_values", "intensity_values"))
                    for key, scale in (("mass_values", "scale_factor"), ("intensity_values", "scale_factor")):
                        s = float(h.variables[key].attrs.get(scale, 1.0) or 1.0)
                        if key == "mass_values":
                            mz = mz * s
                        else:
                            inten = inten * s
                for j in range(len(at)):
                    a, b = int(at[j]) - lo, int(at[j] + k[j]) - lo
                    yield pa.RecordBatch.from_arrays([pa.array([dataset_id] * (b - a)), pa.array(np.full(b - a, px + j * by)), pa.array(np.arange(b - a)), pa.array(mz[a:b]), pa.array(inten[a:b])], ["dataset_id", "pixel_id", "peak_idx", "mz", "intensity"])

    df = spark.createDataFrame(jobs, "path string, first long, n long, px long, step long").repartition(max(1, len(jobs)), "path", "first")
    return df.mapInArrow(run, PEAKS)


def _jobs(path: str, n: int, px: int, step: int) -> list[tuple[str, int, int, int, int]]:
    return [(path, a, min(SCANS, n - a), px + a * step, step) for a in range(0, n, SCANS)]


def _coords(spark: SparkSession, dataset_id: str, n: int, x, y) -> DataFrame:
    return spark.range(n).select(F.lit(dataset_id).alias("dataset_id"), F.col("id").alias("pixel_id"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def read_cdf(spark: SparkSession, path: str, dataset_id: str | None = None) -> MsiDataset:
    """A single run: one pixel a scan on a grid of one line; where it was taken isn't in the file."""
    warnings.warn("a single ANDI-MS file has no positions; its scans become one line", stacklevel=2)
    name = dataset_id or os.path.splitext(os.path.basename(path))[0]
    h = header(path)
    n = h.dims[h.variables["scan_index"].dims[0]]
    lo, hi = scan_bounds(path, h)
    found = metadata(h, False) | ({"mz_min": lo, "mz_max": hi} if hi > lo else {})
    ep, where = sidecar.experiment(found, "andims", [os.path.splitext(path)[0], path])
    pixels, shape = pixels_of(_coords(spark, name, n, F.col("id"), F.lit(0)), (1, n))
    return MsiDataset(pixels, peaks=peaks_of(spark, _jobs(path, n, 0, 1), name), grid_shape=shape, metadata=ep, sources=where, identity=DatasetIdentity(path, sha256_file(path)))


def natural_key(path: str) -> tuple[bool, int, str]:
    """By the last whole number in the stem; names without one come last."""
    stem = os.path.splitext(os.path.basename(path))[0]
    numbers = re.findall(r"\d+", stem)
    return not numbers, int(numbers[-1]) if numbers else 0, stem


def infer_layout(folder: str, axis_along_files: str = "y", serpentine: bool = False) -> CdfLayout:
    files = sorted((os.path.join(folder, f) for f in os.listdir(folder) if f.lower().endswith((".cdf", ".nc"))), key=natural_key)
    if not files:
        raise FileNotFoundError(f"no ANDI-MS files in {folder}")
    scans = []
    for f in files:
        h = header(f)
        scans.append(h.dims[h.variables["scan_index"].dims[0]])
    return CdfLayout(tuple(files), tuple(scans), axis_along_files, serpentine)


def read_cdf_image(spark: SparkSession, folder: str, layout: CdfLayout | None = None, dataset_id: str | None = None) -> MsiDataset:
    """The runs of a folder as the lines of an image, cut to the shortest; serpentine lines are read backwards."""
    lay = layout or infer_layout(folder)
    name = dataset_id or os.path.basename(os.path.normpath(folder))
    per = lay.scans_per_line
    if len(set(lay.scans)) > 1:
        warnings.warn(f"lines hold {min(lay.scans)} to {max(lay.scans)} scans; all are cut to {per}", stacklevel=2)
    jobs, bounds, found = [], [], []
    for i, f in enumerate(lay.files):
        back = lay.serpentine and i % 2 == 1
        for path, a, n, _, _ in _jobs(f, per, 0, 1):
            jobs.append((path, a, n, i * per + (per - 1 - a if back else a), -1 if back else 1))
        h = header(f)
        bounds.append(scan_bounds(f, h))
        found.append(metadata(h, True))
    if any(m != found[0] for m in found):
        warnings.warn("the lines' files differ in their metadata; the first file's counts", stacklevel=2)
    lo, hi = min(b[0] for b in bounds), max(b[1] for b in bounds)
    ep, where = sidecar.experiment(found[0] | ({"mz_min": lo, "mz_max": hi} if hi > lo else {}), "andims", [os.path.join(folder, name), os.path.normpath(folder)])
    line, scan = F.floor(F.col("id") / per), F.col("id") % per
    along_y = lay.axis_along_files == "y"
    n = len(lay.files)
    pixels, shape = pixels_of(_coords(spark, name, n * per, scan if along_y else line, line if along_y else scan), (n, per) if along_y else (per, n))
    return MsiDataset(pixels, peaks=peaks_of(spark, jobs, name), grid_shape=shape, metadata=ep, sources=where, identity=DatasetIdentity(folder, "", None, tuple((os.path.basename(f), sha256_file(f)) for f in lay.files)))

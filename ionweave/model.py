"""The data model: immutable datasets of lazily evaluated tables, and what describes them.

Tables carry ``dataset_id`` in every key, so one plan serves one acquisition or a cohort:

* ``pixels(dataset_id, pixel_id, x, y, gx, gy, grid_idx)``
* ``peaks(dataset_id, pixel_id, peak_idx, mz, intensity)``
* ``cells(dataset_id, pixel_id, channel, intensity)`` with intensities above 0 only, and
  ``channels(dataset_id, channel, mz, prevalence, n_peaks)``: an absent cell is 0.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import dataclasses
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("unknown", "tof_axial", "tof_reflectron", "qtof", "orbitrap", "fticr")
IONIZATIONS = ("unknown", "maldi", "desi", "sims", "esi")
MODES = ("unknown", "centroided", "profile")
POLARITIES = ("positive", "negative")
#: Where a metadata value may come from, the later the stronger.
PROVENANCE = ("default", "imzml", "andims", "sidecar", "spec_xml", "user")

PEAKS = "dataset_id string, pixel_id bigint, peak_idx bigint, mz double, intensity double"
PIXELS = "dataset_id string, pixel_id bigint, x int, y int, gx int, gy int, grid_idx bigint"
DATASET, PIXEL = ["dataset_id"], ["dataset_id", "pixel_id"]


def _one_of(name: str, value: str, allowed: Iterable[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class ExperimentParams:
    """How a dataset was acquired; validated on creation."""

    instrument_family: str = "unknown"
    ionization: str = "unknown"
    profile_or_centroided: str = "unknown"
    polarity: str = "positive"
    mz_min: float = 0.0
    mz_max: float = 1.0
    pixel_size_um: float | None = None
    sample_type: str | None = None
    notes: str = ""

    def __post_init__(self) -> None:
        _one_of("instrument_family", self.instrument_family, FAMILIES)
        _one_of("ionization", self.ionization, IONIZATIONS)
        _one_of("profile_or_centroided", self.profile_or_centroided, MODES)
        _one_of("polarity", self.polarity, POLARITIES)
        if not self.mz_max > self.mz_min:
            raise ValueError("mz_max must exceed mz_min")
        if self.pixel_size_um is not None and not self.pixel_size_um > 0:
            raise ValueError("pixel_size_um must be positive")


def merge_metadata(*layers: tuple[str, Mapping[str, Any]]) -> tuple[dict[str, Any], dict[str, str]]:
    """Values and their sources; a stronger source replaces a weaker one, unknown keys are left out."""
    known = {f.name: f for f in dataclasses.fields(ExperimentParams)}
    values = {n: f.default for n, f in known.items()}
    source = dict.fromkeys(known, "default")
    for where, layer in sorted(layers, key=lambda x: PROVENANCE.index(x[0])):
        for k, v in layer.items():
            if k in known and v is not None:
                kind = type(known[k].default) if known[k].default is not None else (float if k == "pixel_size_um" else str)
                values[k], source[k] = kind(v), where
    return values, source


@dataclass(frozen=True)
class RoiDef:
    """A polygon of (y, x) vertices in grid coordinates."""

    name: str
    vertices: tuple[tuple[float, float], ...]
    is_background: bool = False

    def __post_init__(self) -> None:
        if len(self.vertices) < 3:
            raise ValueError("a region needs at least three vertices")


@dataclass(frozen=True)
class DatasetIdentity:
    source_path: str = ""
    content_sha256: str = ""
    declared_md5: str | None = None
    extra: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class OpRecord:
    op_name: str
    params_hash: str
    input_hash: str
    output_hash: str
    summary: tuple[tuple[str, float], ...] = ()


def _plain(obj: Any) -> Any:
    if dataclasses.is_dataclass(obj) and not isinstance(obj, type):
        return {f.name: _plain(getattr(obj, f.name)) for f in dataclasses.fields(obj)}
    if isinstance(obj, Mapping):
        return {str(k): _plain(v) for k, v in obj.items()}
    if isinstance(obj, list | tuple | set | frozenset):
        return [_plain(v) for v in (sorted(obj) if isinstance(obj, set | frozenset) else obj)]
    return obj if obj is None or isinstance(obj, bool | int | float | str) else str(obj)


def hash_obj(obj: Any) -> str:
    """SHA-256 of the canonical JSON (sorted keys) of plain values and dataclasses."""
    return hashlib.sha256(json.dumps(_plain(obj), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def combine_hashes(*parts: str) -> str:
    """A digest of digests; the order counts."""
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def _file_digest(path: str, kind: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind).hexdigest()


def sha256_file(path: str) -> str:
    return _file_digest(path, "sha256")


def md5_file(path: str) -> str:
    return _file_digest(path, "md5")


@dataclass(frozen=True)
class MsiDataset:
    """Peaks, or cells with channels, of one or more acquisitions; never changed in place."""

    pixels: DataFrame
    peaks: DataFrame | None = None
    cells: DataFrame | None = None
    channels: DataFrame | None = None
    grid_shape: tuple[int, int] = (0, 0)
    metadata: ExperimentParams = ExperimentParams()
    sources: Mapping[str, str] = field(default_factory=dict)
    identity: DatasetIdentity = DatasetIdentity()
    history: tuple[OpRecord, ...] = ()
    rois: tuple[RoiDef, ...] = ()
    rng_seed: int = 0
    extras: Mapping[str, DataFrame] = field(default_factory=dict)

    @property
    def is_matrix(self) -> bool:
        return self.cells is not None

    def need_peaks(self, op: str) -> DataFrame:
        if self.peaks is None:
            raise NotImplementedError(f"{op} needs peak lists; run it before the peaks are aligned")
        return self.peaks

    def need_cells(self, op: str) -> DataFrame:
        if self.cells is None:
            raise RuntimeError(f"{op} needs aligned channels; run an alignment first")
        return self.cells

    def n_pixels(self) -> DataFrame:
        """(dataset_id, n_pixels): one row a dataset."""
        return self.pixels.groupBy("dataset_id").agg(F.count("*").alias("n_pixels"))

    def with_(self, **changes: Any) -> MsiDataset:
        return dataclasses.replace(self, **changes)

    def with_peaks(self, peaks: DataFrame) -> MsiDataset:
        return self.with_(peaks=peaks, cells=None, channels=None)

    def with_matrix(self, cells: DataFrame, channels: DataFrame) -> MsiDataset:
        return self.with_(peaks=None, cells=cells, channels=channels)

    def with_extras(self, **tables: DataFrame) -> MsiDataset:
        return self.with_(extras={**self.extras, **tables})

    def with_rois(self, *rois: RoiDef) -> MsiDataset:
        return self.with_(rois=tuple(rois))

    def with_history(self, record: OpRecord) -> MsiDataset:
        return self.with_(history=(*self.history, record))

    def hash(self) -> str:
        """Identity and lineage: what the data were, and what was done to them."""
        return combine_hashes(hash_obj(self.identity), *(r.output_hash for r in self.history))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder takes its place with a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ionweave-")
        atexit.register(shutil.rmtree, path[7:], True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_held: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("held", default=None)


@contextlib.contextmanager
def held_until_end(spark: SparkSession):
    """Tables that :func:`hold` writes inside go at the end: for work whose results are written by then."""
    mine: list[str] = []
    before = _held.set(mine)
    try:
        yield
    finally:
        _held.reset(before)
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hold(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the shared folder and read it again: plans stay
    short, and a lost executor costs no earlier step."""
    out = f"{shared_dir(df.sparkSession)}/hold-{uuid.uuid4().hex}"
    if (mine := _held.get()) is not None:
        mine.append(out)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def pixels_of(coords: DataFrame, grid_shape: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """Pixel table and grid of (dataset_id, pixel_id, x, y): a least coordinate of 1 over both axes
    means that counting starts at 1, else at 0. Positions outside the grid raise."""
    lo, wide, high = coords.agg(F.min(F.least("x", "y")), F.max("x"), F.max("y")).first()
    start = 1 if lo is not None and lo >= 1 else 0
    if grid_shape is None:
        grid_shape = (0, 0) if lo is None else (high + 1 - start, wide + 1 - start)
    h, w = grid_shape
    if lo is not None and (lo < 0 or wide - start >= w or high - start >= h):
        raise ValueError("coordinates out of grid")
    gx, gy = F.col("x") - start, F.col("y") - start
    return coords.select("dataset_id", F.col("pixel_id").cast("bigint"), F.col("x").cast("int"), F.col("y").cast("int"), gx.cast("int").alias("gx"), gy.cast("int").alias("gy"), (gy.cast("bigint") * w + gx).alias("grid_idx")), grid_shape

"""Operators: named, parametrised steps from one immutable dataset to the next."""

from __future__ import annotations

import dataclasses
import functools
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PIXEL, ExperimentParams, MsiDataset, OpRecord, combine_hashes, hash_obj


@dataclass(frozen=True)
class Diagnostic:
    """``summary``: a one-row table of DOUBLE columns, computed when asked for; ``payload``: tables to plot."""

    name: str
    summary: DataFrame | None = None
    payload: dict[str, DataFrame] = field(default_factory=dict)
    figure_hint: str | None = None
    notes: tuple[str, ...] = ()

    def values(self) -> dict[str, float]:
        row = self.summary.first() if self.summary is not None else None
        return {} if row is None else {k: float("nan") if v is None else float(v) for k, v in row.asDict().items()}


@dataclass(frozen=True)
class OpResult:
    dataset: MsiDataset
    diagnostics: tuple[Diagnostic, ...] = ()


class Operator:
    """Subclasses set ``name`` and ``params_cls`` and write ``run``; they never change their input."""

    name: ClassVar[str] = ""
    params_cls: ClassVar[type] = object

    def default_params(self, ep: ExperimentParams) -> Any:
        return self.params_cls()

    def validate(self, ep: ExperimentParams) -> list[str]:
        """Warnings about using the operator on such data."""
        return []

    def run(self, ds: MsiDataset, params: Any, seed: int) -> OpResult:
        raise NotImplementedError

    def apply(self, ds: MsiDataset, params: Any = None, *, seed: int = 0) -> OpResult:
        params = self.default_params(ds.metadata) if params is None else params
        out = self.run(ds, params, seed)
        p, before = hash_obj(dataclasses.asdict(params)), ds.hash()
        record = OpRecord(self.name, p, before, combine_hashes(self.name, p, before, str(seed)))
        return OpResult(out.dataset.with_history(record), out.diagnostics)


def one_row(*tables: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return functools.reduce(DataFrame.crossJoin, tables)


def numbers(**values: float) -> list[Column]:
    """Constants of a summary."""
    return [F.lit(float(v)).alias(k) for k, v in values.items()]


def kept_per_pixel(pixels: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row: the least, median and largest number of peaks of a pixel, pixels without any counted."""
    n = pixels.select(*PIXEL).join(peaks.groupBy(*PIXEL).agg(F.count("*").alias("k")), PIXEL, "left").select(F.coalesce("k", F.lit(0)).cast("double").alias("k"))
    return n.agg(F.min("k").alias("kept_per_pixel_min"), F.median("k").alias("kept_per_pixel_median"), F.max("k").alias("kept_per_pixel_max"))


def prevalences(channels: DataFrame) -> DataFrame:
    """One row: the least, median and largest prevalence."""
    return channels.agg(F.min("prevalence").alias("prevalence_min"), F.median("prevalence").alias("prevalence_median"), F.max("prevalence").alias("prevalence_max"))


_REGISTRY: dict[str, Operator] = {}


def register(cls: type[Operator]) -> type[Operator]:
    if not cls.name or cls.name in _REGISTRY:
        raise ValueError(f"operator name {cls.name!r} is empty or taken")
    _REGISTRY[cls.name] = cls()
    return cls


def operator(name: str) -> Operator:
    if name not in _REGISTRY:
        raise KeyError(f"no operator {name!r}; there are {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)

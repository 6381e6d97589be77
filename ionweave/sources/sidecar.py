"""Metadata files beside the data: the first that exists counts; unknown keys are left out."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from typing import Any

from ..model import ExperimentParams, merge_metadata
from . import spec

NAMES = (".metadata.json", ".experiment.json", ".spec.xml")


def find(stems: Iterable[str]) -> str | None:
    return next((s + n for s in stems for n in NAMES if os.path.isfile(s + n)), None)


def read(path: str) -> tuple[str, dict[str, Any]]:
    """(source, values) of a sidecar file."""
    if path.endswith(".spec.xml"):
        return "spec_xml", spec.read(path).experiment
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return "sidecar", data if isinstance(data, dict) else {}


def experiment(header: dict[str, Any], source: str, stems: Iterable[str], user: dict[str, Any] | None = None) -> tuple[ExperimentParams, dict[str, str]]:
    """The header's values, overlaid by the first sidecar and then by what the user gives."""
    layers = [(source, header)]
    if (path := find(stems)) is not None:
        layers.append(read(path))
    if user:
        layers.append(("user", user))
    values, where = merge_metadata(*layers)
    return ExperimentParams(**values), where

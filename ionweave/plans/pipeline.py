"""Pipelines: checked chains of operators, run with a cache of results by content."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..model import ExperimentParams, MsiDataset, combine_hashes, hash_obj
from ..operators import OpResult, operator
from ..operators.tolerance import ToleranceParams
from .store import Store, fingerprint


def versions() -> dict[str, str]:
    import numpy
    import pyspark

    from .. import __version__

    return {"ionweave": __version__, "python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}


@dataclass(frozen=True)
class Node:
    id: str
    op_name: str
    params: Any = None
    upstream: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    """Nodes in an order in which every upstream node comes first."""

    nodes: tuple[Node, ...]
    rng_seed: int = 0
    library_versions: dict[str, str] = field(default_factory=versions)

    def __post_init__(self) -> None:
        seen: set[str] = set()
        every = {n.id for n in self.nodes}
        for n in self.nodes:
            if n.id in seen:
                raise ValueError(f"two nodes are named {n.id!r}")
            for u in n.upstream:
                if u not in every:
                    raise ValueError(f"node {n.id!r} follows {u!r}, which doesn't exist")
                if u not in seen:
                    raise ValueError(f"node {n.id!r} comes before {u!r}, which it follows")
            seen.add(n.id)

    def node(self, node_id: str) -> Node:
        return next(n for n in self.nodes if n.id == node_id)

    def replace(self, node_id: str, **changes: Any) -> Pipeline:
        return dataclasses.replace(self, nodes=tuple(dataclasses.replace(n, **changes) if n.id == node_id else n for n in self.nodes))

    def hash(self) -> str:
        return hash_obj([[n.id, n.op_name, n.params, n.upstream] for n in self.nodes] + [self.rng_seed])


def node_seed(seed: int, node_id: str) -> int:
    text = json.dumps({"node": node_id, "seed": seed}, sort_keys=True)
    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) & 0xFFFFFFFF


def chain(ep: ExperimentParams, steps: list[tuple[str, str]], seed: int) -> Pipeline:
    """A straight pipeline of (id, operator) with default parameters."""
    nodes, last = [], ()
    for node_id, op in steps:
        nodes.append(Node(node_id, op, operator(op).default_params(ep), last))
        last = (node_id,)
    return Pipeline(tuple(nodes), seed)


def recommend(ep: ExperimentParams, *, rng_seed: int = 0) -> Pipeline:
    """The default chain for an experiment: drifting analysers are recalibrated, profile data are picked
    by wavelets, and tissue gets the spatial filter."""
    steps = [("ref", "detect_reference_ions"), ("tol", "empirical_tolerance_from_reference_ions")]
    if ep.instrument_family in ("tof_axial", "tof_reflectron", "qtof"):
        steps.append(("recal", "msiwarp_recalibrate"))
    steps += [("norm", "median_normalize"), ("pick", "cwt_peak_pick" if ep.profile_or_centroided == "profile" else "snr_peak_pick"), ("consensus", "kde_consensus_alignment")]
    if ep.sample_type == "tissue":
        steps.append(("spatial", "morans_i_permutation"))
    return chain(ep, steps, rng_seed)


#: Operators that can stand in for another at the same place.
VARIANTS = (
    ("msiwarp_recalibrate", "lock_mass_recalibrate"),
    ("median_normalize", "tic_normalize", "reference_ion_normalize"),
    ("snr_peak_pick", "cwt_peak_pick"),
    ("kde_consensus_alignment", "dbscan_consensus"),
)
#: Optional operators and whether they come first or last.
OPTIONAL = {"hot_pixel_filter": "first", "prevalence_fdr_filter": "last", "background_subtract": "last"}


def with_variant(p: Pipeline, node_id: str, op: str, ep: ExperimentParams) -> Pipeline:
    """``p`` with another operator of the same kind at a node, with its default parameters."""
    group = next((v for v in VARIANTS if p.node(node_id).op_name in v), ())
    if op not in group:
        raise ValueError(f"{op} can't stand in for {p.node(node_id).op_name}")
    return p.replace(node_id, op_name=op, params=operator(op).default_params(ep))


def with_optional(p: Pipeline, op: str, ep: ExperimentParams, node_id: str | None = None) -> Pipeline:
    """``p`` with an optional operator at its end or start, the rest threaded anew."""
    new = Node(node_id or op, op, operator(op).default_params(ep))
    nodes = [new, *p.nodes] if OPTIONAL[op] == "first" else [*p.nodes, new]
    out, last = [], ()
    for n in nodes:
        out.append(dataclasses.replace(n, upstream=last))
        last = (n.id,)
    return dataclasses.replace(p, nodes=tuple(out))


@dataclass(frozen=True)
class RunResult:
    dataset: MsiDataset
    results: dict[str, OpResult]

    def summaries(self) -> dict[str, dict[str, float]]:
        return {k: {n: v for d in r.diagnostics for n, v in d.values().items()} for k, r in self.results.items()}


class Runner:
    """Runs pipelines; a node whose operator, parameters, seed and input are known isn't run again.

    Without a store, results are known as long as the runner is, and inputs are the same if they are the same
    object. With one, results outlive the session, and inputs are the same if their contents are."""

    def __init__(self, store: Store | None = None) -> None:
        self.cache: dict[str, OpResult] = {}
        self.executed: list[str] = []
        self.store = store
        #: Inputs by identity; they are held, so no other object can take their place.
        self.inputs: list[tuple[MsiDataset, str]] = []

    def _start(self, ds: MsiDataset) -> str:
        for known, key in self.inputs:
            if known is ds:
                return key
        key = fingerprint(ds) if self.store else combine_hashes(ds.hash(), uuid.uuid4().hex)
        self.inputs.append((ds, key))
        return key

    def _known(self, key: str) -> OpResult | None:
        if key not in self.cache and self.store and (found := self.store.get(key)):
            self.cache[key] = found
        return self.cache.get(key)

    def run(self, ds: MsiDataset, p: Pipeline, *, on_progress: Callable[[int, int, str], None] | None = None, on_node: Callable[[str, OpResult], None] | None = None) -> RunResult:
        results: dict[str, OpResult] = {}
        keys: dict[str, str] = {}
        start = self._start(ds)
        self.executed = []
        for k, n in enumerate(p.nodes):
            if on_progress:
                on_progress(k, len(p.nodes), n.id)
            src = results[n.upstream[-1]].dataset if n.upstream else ds
            seed = node_seed(p.rng_seed, n.id)
            key = keys[n.id] = combine_hashes(n.op_name, hash_obj(n.params), str(seed), keys[n.upstream[-1]] if n.upstream else start)
            if self._known(key) is None:
                made = operator(n.op_name).apply(src, n.params, seed=seed)
                self.cache[key] = self.store.put(key, made) if self.store else made
                self.executed.append(n.id)
            results[n.id] = self.cache[key]
            if on_node:
                on_node(n.id, results[n.id])
        return RunResult(results[p.nodes[-1].id].dataset if p.nodes else ds, results)


def default_channels(ds: MsiDataset, seed: int = 0, replicates: int = 100, **changed: Any) -> DataFrame:
    """(channel, mz, prevalence, n_peaks) that the recommended chain finds, its tolerance with so many replicates over
    pixels; ``changed``: parameters of other nodes."""
    p = recommend(ds.metadata, rng_seed=seed).replace("tol", params=ToleranceParams(bootstrap_B=replicates, block_bootstrap=False))
    for node, params in changed.items():
        p = p.replace(node, params=params)
    return Runner().run(ds, p).dataset.channels.select("channel", "mz", "prevalence", "n_peaks")

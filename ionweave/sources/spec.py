"""Pipeline manifests: provenance, experiment, operators with parameters, and scalar diagnostics as XML."""

from __future__ import annotations

import dataclasses
import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from ..model import DatasetIdentity, ExperimentParams
from ..operators import operator
from ..plans.pipeline import Node, Pipeline

NAMESPACE = "urn:ionweave:spec:1"


@dataclass(frozen=True)
class Spec:
    pipeline: Pipeline
    experiment: dict[str, Any]
    provenance: dict[str, str]
    diagnostics: dict[str, dict[str, float]]


def _text(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else "INF" if v == math.inf else "-INF" if v == -math.inf else repr(v)
    return "" if v is None else str(v)


def _value(s: str, like: Any) -> Any:
    if isinstance(like, bool):
        return s == "true"
    if isinstance(like, int):
        return int(s)
    if isinstance(like, float):
        return float(s.replace("INF", "inf"))
    return s if s or isinstance(like, str) else None


def write(path: str, p: Pipeline, ep: ExperimentParams, identity: DatasetIdentity = DatasetIdentity(), diagnostics: dict[str, dict[str, float]] | None = None) -> None:
    root = ET.Element("spec", xmlns=NAMESPACE, createdAt=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    prov = ET.SubElement(root, "provenance", sourcePath=identity.source_path, contentSha256=identity.content_sha256)
    for k, v in p.library_versions.items():
        ET.SubElement(prov, "library", name=k, version=v)
    exp = ET.SubElement(root, "experiment")
    for f in dataclasses.fields(ep):
        if (v := getattr(ep, f.name)) is not None:
            ET.SubElement(exp, "value", name=f.name).text = _text(v)
    pipe = ET.SubElement(root, "pipeline", rngSeed=str(p.rng_seed))
    for n in p.nodes:
        node = ET.SubElement(pipe, "node", id=n.id, operator=n.op_name)
        for u in n.upstream:
            ET.SubElement(node, "upstream", ref=u)
        for f in dataclasses.fields(n.params) if dataclasses.is_dataclass(n.params) else ():
            ET.SubElement(node, "param", name=f.name).text = _text(getattr(n.params, f.name))
        for k, v in (diagnostics or {}).get(n.id, {}).items():
            ET.SubElement(node, "diagnostic", name=k).text = _text(float(v))
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def read(path: str) -> Spec:
    """A manifest; parameters get the types of their operator's defaults, and unknown ones are left out."""
    root = ET.parse(path).getroot()
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    like = {f.name: f.default for f in dataclasses.fields(ExperimentParams)}
    exp = {}
    for v in root.iterfind("experiment/value"):
        if (k := v.get("name")) in like:
            exp[k] = _value(v.text or "", 0.0 if k == "pixel_size_um" else like[k])
    nodes, diag = [], {}
    for n in root.iterfind("pipeline/node"):
        cls = operator(n.get("operator")).params_cls
        defaults = {f.name: f.default for f in dataclasses.fields(cls)}
        params = {q.get("name"): _value(q.text or "", defaults[q.get("name")]) for q in n.iterfind("param") if q.get("name") in defaults}
        nodes.append(Node(n.get("id"), n.get("operator"), cls(**params), tuple(u.get("ref") for u in n.iterfind("upstream"))))
        diag[n.get("id")] = {d.get("name"): float((d.text or "NaN").replace("INF", "inf")) for d in n.iterfind("diagnostic")}
    pipe = root.find("pipeline")
    prov = root.find("provenance")
    libs = {x.get("name"): x.get("version") for x in root.iterfind("provenance/library")}
    return Spec(Pipeline(tuple(nodes), int(pipe.get("rngSeed", "0")), libs), exp, dict(prov.attrib) if prov is not None else {}, diag)

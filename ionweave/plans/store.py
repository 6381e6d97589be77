"""Results of operators by content, in a folder that outlives the session.

An entry is a saved dataset with its diagnostics, below a name that is the key of what it was made of. It
is written to a folder of another name, which is renamed when all is there, so no reader sees a part of one; of
two sessions that write the same entry the first stands.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MsiDataset, combine_hashes, hash_obj
from ..operators import OpResult
from ..operators.base import Diagnostic
from ..sources import files, native

DIAGNOSTICS = "diagnostics.json"


def _marks(df: DataFrame) -> list[str]:
    """Number of rows and two sums of their hashes: the order of rows doesn't count."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    big = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return [str(v) for v in df.agg(F.count("*"), big(F.xxhash64(*cols)), big(F.xxhash64(F.lit(1), *cols))).first()]


def fingerprint(ds: MsiDataset) -> str:
    """What a dataset holds: its file's digest if it is known, else its tables' rows; with all that describes it."""
    about = hash_obj([ds.metadata, ds.rois, ds.grid_shape, ds.rng_seed])
    if ds.identity.content_sha256:
        return combine_hashes(ds.hash(), about)
    tables = {t: getattr(ds, t) for t in native.TABLES if getattr(ds, t) is not None} | {f"extras-{k}": v for k, v in ds.extras.items()}
    return combine_hashes(ds.hash(), about, *(hash_obj([t, sorted(df.columns), _marks(df)]) for t, df in sorted(tables.items())))


class Store:
    """Entries below ``folder``, on any file system of Spark."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, key: str) -> OpResult | None:
        at = f"{self.folder}/{key}"
        if not files.spark_exists(self.spark, at):
            return None
        told = json.loads(self.spark.read.text(f"{at}/{DIAGNOSTICS}").first()[0])
        table = lambda name: self.spark.read.parquet(f"{at}/{name}")
        found = tuple(
            Diagnostic(d["name"], table(f"diagnostic-{k}") if d["summary"] else None, {n: table(f"diagnostic-{k}-{j}") for j, n in enumerate(d["payload"])}, d["figure_hint"], tuple(d["notes"]))
            for k, d in enumerate(told)
        )
        return OpResult(native.read(self.spark, at), found)

    def put(self, key: str, result: OpResult) -> OpResult:
        """Save a result; returns it as it is read back, cut off from what made it."""
        part = f"{self.folder}/.{key}-{uuid.uuid4().hex}"
        native.write(result.dataset, part)
        for k, d in enumerate(result.diagnostics):
            for name, df in ([(f"diagnostic-{k}", d.summary)] if d.summary is not None else []) + [(f"diagnostic-{k}-{j}", df) for j, df in enumerate(d.payload.values())]:
                df.write.parquet(f"{part}/{name}")
        told = [{"name": d.name, "summary": d.summary is not None, "payload": list(d.payload), "figure_hint": d.figure_hint, "notes": list(d.notes)} for d in result.diagnostics]
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{part}/{DIAGNOSTICS}")
        # Without a folder of that name the rename is the last step; with one, the entry is there already.
        if files.spark_exists(self.spark, f"{self.folder}/{key}") or not files.spark_rename(self.spark, part, f"{self.folder}/{key}"):
            files.spark_delete(self.spark, part)
        return self.get(key) or dataclasses.replace(result)

    def keys(self) -> list[str]:
        """Entries, the one that was written last first."""
        return [n for n, _ in sorted(files.spark_folders(self.spark, self.folder), key=lambda e: (-e[1], e[0])) if not n.startswith(".")]

    def evict(self, most: int) -> list[str]:
        """Remove all entries but the last ``most``, and what unfinished writers have left; returns the removed keys."""
        gone = self.keys()[most:]
        for name in gone + [n for n, _ in files.spark_folders(self.spark, self.folder) if n.startswith(".")]:
            files.spark_delete(self.spark, f"{self.folder}/{name}")
        return gone

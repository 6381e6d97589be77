"""Align a folder of datasets to one axis: ``python -m ionweave.cli.cohort_align root [-o folder]``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from ..model import MsiDataset
from ..plans import cohort, diagnostics
from ..session import session
from ..sources import imzml, load, tiff


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohort-align", description="Align the datasets of a folder to shared channels.")
    p.add_argument("root")
    p.add_argument("-o", "--output")
    p.add_argument("--pattern", default="*.imzML")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--no-recalibrate", action="store_true")
    p.add_argument("--bandwidth-ppm", type=float, default=50.0)
    p.add_argument("--min-prevalence", type=float, default=0.05)
    p.add_argument("--rng-seed", type=int, default=0)
    p.add_argument("--no-imzml", action="store_true")
    p.add_argument("--no-tiff", action="store_true")
    return p


def described(index: int, d: MsiDataset) -> dict:
    """What the summary tells of a dataset."""
    ep = d.metadata
    return {"index": index, "source_path": d.identity.source_path, "n_pixels": d.pixels.count(), "grid_shape": list(d.grid_shape), "instrument_family": ep.instrument_family, "ionization": ep.ionization, "polarity": ep.polarity, "mode": ep.profile_or_centroided}


def summary(r: cohort.CohortResult, parts: list[MsiDataset], values: dict[str, float], rng_seed: int) -> dict:
    """The axis and its prevalences, the datasets, the diagnostics and the parameters; channels are bounded by the density's grid."""
    axis = r.prevalence.orderBy("channel").collect()
    per = r.per_dataset.groupBy("dataset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "prevalence"))), lambda s: s["prevalence"]).alias("p")).collect()
    p = r.params
    return {
        "n_datasets": len(parts), "shared_consensus_mz": [a["mz"] for a in axis], "cohort_prevalence": [a["prevalence"] for a in axis], "per_dataset_prevalence": {x["dataset_id"]: x["p"] for x in per},
        "datasets": [described(k, d) for k, d in enumerate(parts)], "diagnostics": values,
        "params": {k: getattr(p, k) for k in ("bandwidth_ppm", "bandwidth_scale", "min_prevalence", "min_prominence_quantile", "n_grid_points", "default_tol_ppm", "pool_normalize", "recalibrate")} | {"rng_seed": rng_seed},
    }


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    try:
        parts = load.load_cohort(spark, args.root, args.pattern, args.recursive)
    except (OSError, ValueError) as e:
        print(f"can't read the cohort: {e}", file=sys.stderr)
        return 2
    try:
        p = cohort.CohortParams(bandwidth_ppm=args.bandwidth_ppm, min_prevalence=args.min_prevalence, recalibrate=not args.no_recalibrate)
        r = cohort.align_cohort(cohort.union(parts), p, args.rng_seed)
        cohort.check(r)
        out = args.output or os.path.join(args.root, "aligned")
        os.makedirs(out, exist_ok=True)
        values = {k: float("nan") if v is None else v for k, v in r.diagnostics.first().asDict().items()}
        print(diagnostics.text({"cohort": values}))
        shared = r.prevalence.select("channel", F.col("prevalence").alias("cohort_prevalence"))
        for d in parts:
            name = d.pixels.first()["dataset_id"]
            mine = lambda df, name=name: df.where(F.col("dataset_id") == name)
            one = d.with_matrix(mine(r.dataset.cells), mine(r.dataset.channels))
            stem = os.path.join(out, name.replace(os.sep, "_") + "_aligned")
            if not args.no_tiff:
                tiff.write_tiff(one, stem + ".tiff", extra=shared)
            if not args.no_imzml:
                imzml.write_imzml(one, stem + ".imzML")
        with open(os.path.join(out, "cohort_summary.json"), "w", encoding="utf-8") as f:
            json.dump(summary(r, parts, values, args.rng_seed), f, indent=1)
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(f"the alignment failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

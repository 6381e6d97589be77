"""Run a manifest's pipeline on a dataset: ``python -m ionweave.cli.apply_spec input spec [-o folder]``.

Exit codes: 0 done, 1 the run failed, 2 the input or the manifest can't be read.
"""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from ..model import ExperimentParams
from ..plans import diagnostics
from ..plans.pipeline import Runner
from ..session import session
from ..sources import imzml, load, spec, tiff


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="apply-spec", description="Run the pipeline of a manifest on a dataset.")
    p.add_argument("input")
    p.add_argument("spec")
    p.add_argument("-o", "--output", default=".")
    p.add_argument("--rng-seed", type=int)
    p.add_argument("--no-imzml", action="store_true")
    p.add_argument("--no-tiff", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    try:
        s = spec.read(args.spec)
        ds = load.load(spark, args.input)
    except Exception as e:  # noqa: BLE001  whatever is wrong with the files is told to the user
        print(f"can't read the input: {e}", file=sys.stderr)
        return 2
    if s.experiment:
        ds = ds.with_(metadata=ExperimentParams(**{**dataclasses.asdict(ds.metadata), **s.experiment}))
    p = s.pipeline if args.rng_seed is None else dataclasses.replace(s.pipeline, rng_seed=args.rng_seed)
    try:
        out = Runner().run(ds, p, on_progress=(lambda k, n, i: print(f"[{k + 1}/{n}] {i}")) if args.verbose else None)
        values = out.summaries()
        print(diagnostics.text(values, {n.id: n.op_name for n in p.nodes}))
        os.makedirs(args.output, exist_ok=True)
        stem = os.path.join(args.output, os.path.splitext(os.path.basename(os.path.normpath(args.input)))[0] + "_processed")
        if not args.no_tiff:
            if out.dataset.is_matrix:
                tiff.write_tiff(out.dataset, stem + ".tiff")
            else:
                print("no channels, so no images are written", file=sys.stderr)
        if not args.no_imzml:
            imzml.write_imzml(out.dataset, stem + ".imzML")
        spec.write(stem + ".spec.xml", p, ds.metadata, ds.identity, values)
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(f"the run failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

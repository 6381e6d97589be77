"""The jobs over small planted inputs: reruns, growing input, failures between steps, command lines."""

from __future__ import annotations

import json
import math
import os
import random
import statistics
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ionweave.model import shared_dir
from ionweave.operators.reference_ions import ReferenceIonParams, reference_ions
from jobs import acquisition_qc as qc
from jobs import reference_ledger as ledger
from jobs.common import UNNAMED, config_of, exists, peaks_of

SCHEMA = "run string, spot bigint, k bigint, mass double, height double"
COLUMNS = {"dataset_id": "run", "pixel_id": "spot", "peak_idx": "k", "mz": "mass", "intensity": "height"}
REFERENCE = {"coarse_tol_ppm": 50.0, "min_prevalence": 0.5, "min_count": 3}


def planted(run, spots, rng, ions=(200.0, 300.0, 400.0), share=1.0):
    """Peaks near some ions in a share of the spots, each spot with a drift of its own, and noise. The
    ions are moved to the middle of their bins, so that none is cut in two."""
    width = math.log1p(REFERENCE["coarse_tol_ppm"] * 1e-6)
    ions = [math.exp((math.floor(math.log(m) / width) + 0.5) * width) for m in ions]
    rows = []
    for s in spots:
        drift = rng.uniform(-4, 4)
        for k, m in enumerate(ions):
            if rng.random() < share:
                rows.append((run, s, k, m * (1 + drift * 1e-6), rng.uniform(50, 100)))
        rows += [(run, s, 100 + j, rng.uniform(500, 900), rng.uniform(0.1, 1)) for j in range(8)]
    return rows


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def config():
    return config_of(qc.__file__) | {"columns": COLUMNS, "reference": REFERENCE, "files_per_batch": 1}


def test_what_is_a_peak(spark, config):
    nan, inf = float("nan"), float("inf")
    bad = [("a", None, 1, 200.0, 1.0), ("a", 1, 1, None, 1.0), ("a", 1, 1, -5.0, 1.0), ("a", 1, 1, 0.0, 1.0), ("a", 1, 1, 200.0, None), ("a", 1, 1, 200.0, -1.0), ("a", 1, 1, nan, 1.0), ("a", 1, 1, inf, 1.0), ("a", 1, 1, 200.0, nan), ("a", 1, 1, 200.0, inf)]
    good = [(None, 1, 1, 200.0, 1.0), ("", 2, None, 200.0, 0.0), ("a", 3, 2, 1e-3, 5.0), ("a", 3, 2, 1e-3, 5.0)]
    got = sorted_rows(peaks_of(spark.createDataFrame(bad + good, SCHEMA), COLUMNS))
    assert got == sorted([(UNNAMED, 1.0, 200.0, 1, 1), (UNNAMED, 0.0, 200.0, 0, 2), ("a", 5.0, 1e-3, 2, 3), ("a", 5.0, 1e-3, 2, 3)], key=repr)


def test_qc_against_plain_python(spark, config, tmp_path):
    rng = random.Random(3)
    rows = planted("a", range(30), rng) + planted("b/ 1=x", range(20), rng, share=0.9)
    rows += [("a", 7, 500 + j, 600.0 + j, 5000.0) for j in range(3)]  # a hot pixel
    rows += [("c", s, 1, 150.0 + 3 * s, 1.0) for s in range(6)]  # a dataset without reference ions
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, rows, src)
    config |= {"snr_mad": 3.0, "hot_k_mad": 5.0, "max_drift_ppm": 2.0}
    assert qc.run(spark, src, out, config) == {"rows": len(rows), "peaks": len(rows)}
    got = {(r.dataset_id, r.pixel_id): r for r in qc.read_pixels(spark, out).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    tic = {}
    for run, spot, _, _, h in rows:
        tic[run, spot] = tic.get((run, spot), 0) + h
    mad = lambda v: statistics.median(abs(x - statistics.median(v)) for x in v)
    for run in ("a", "b/ 1=x", "c"):
        own = [v for (r, _), v in tic.items() if r == run]
        limit = statistics.median(own) + 5 * 1.4826 * mad(own)
        for (r, s), v in tic.items():
            if r != run:
                continue
            mine = [x for x in rows if x[:2] == (r, s)]
            heights = [x[4] for x in mine]
            noise = 3 * 1.4826 * mad(heights)
            seen = got[r, s]
            assert seen.tic == pytest.approx(v) and seen.base_peak == max(heights) and seen.n_peaks == len(mine)
            assert seen.threshold == pytest.approx(noise) and seen.n_kept == sum(h > noise for h in heights)
            assert seen.hot == (v > limit) and seen.n_refs == sum(x[2] < 100 and run != "c" for x in mine)
            bad, warn = seen.hot or not seen.n_refs, seen.n_refs and abs(seen.drift_ppm) > 2.0 or seen.n_kept < config["min_share_kept"] * seen.n_peaks
            assert seen.grade == ("bad" if bad else "warn" if warn else "ok")
    assert got["a", 7].hot and {r.grade for r in got.values()} == {"ok", "warn", "bad"}
    ions = qc.read_ions(spark, out).collect()
    assert {(r.dataset_id, round(r.mz)) for r in ions} == {(d, m) for d in ("a", "b/ 1=x") for m in (200, 300, 400)}


def test_qc_rerun_and_part_run(spark, config, tmp_path):
    rng = random.Random(4)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, planted("a", range(12), rng) + planted("b", range(12), rng), src)
    qc.run(spark, src, out, config)
    first = sorted_rows(qc.read_pixels(spark, out)), sorted_rows(qc.read_ions(spark, out))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    qc.run(spark, src, out, config)
    assert (sorted_rows(qc.read_pixels(spark, out)), sorted_rows(qc.read_ions(spark, out))) == first
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    # A run over a new input of one dataset leaves the other; its ions of before no longer count.
    other = f"file://{tmp_path}/other"
    write(spark, [("b", s, 1, 150.0 + 3 * s, 1.0) for s in range(6)], other)
    qc.run(spark, other, out, config)
    assert [r for r in sorted_rows(qc.read_pixels(spark, out)) if "a" in r] == [r for r in first[0] if "a" in r]
    assert {r.dataset_id for r in qc.read_ions(spark, out).collect()} == {"a"}
    assert qc.read_pixels(spark, out).where("dataset_id = 'b'").count() == 6


def test_qc_of_nothing(spark, config, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, [], src)
    assert qc.run(spark, src, out, config) == {"rows": 0, "peaks": 0}
    write(spark, planted("a", range(5), random.Random(1)), src)
    qc.run(spark, src, out, config)
    assert qc.read_pixels(spark, out).count() == 5


def expected(spark, rows):
    peaks = peaks_of(spark.createDataFrame(rows, SCHEMA), COLUMNS)
    n = peaks.groupBy("dataset_id").agg(F.count_distinct("pixel_id").alias("n_pixels"))
    return sorted((r.dataset_id, r.ref_id, round(r.mz, 9), round(r.prevalence, 12), r.n_obs) for r in reference_ions(peaks, n, ReferenceIonParams(**REFERENCE))[0].collect())


def held(spark, out):
    return sorted((r.dataset_id, r.ref_id, round(r.mz, 9), round(r.prevalence, 12), r.n_obs) for r in ledger.read_ions(spark, out).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_ledger_over_growing_input(spark, config, tmp_path):
    rng = random.Random(5)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    lines = [planted("a", range(10), rng), planted("b", range(8), rng, (250.0, 350.0)), planted("a", range(10, 25), rng, (200.0, 450.0)), planted("a", range(5, 12), rng, (200.0, 300.0)), planted("c", range(6), rng)]
    write(spark, lines[0], src)
    write(spark, lines[1], src)
    assert ledger.run(spark, src, out, config) == len(lines[0] + lines[1])
    assert held(spark, out) == expected(spark, lines[0] + lines[1])
    b_files = {k: v for k, v in files(tmp_path / "out").items() if "dataset_id=b" in k}
    for new in lines[2:]:
        write(spark, new, src)
    assert ledger.run(spark, src, out, config) == sum(map(len, lines[2:]))
    assert held(spark, out) == expected(spark, sum(lines, []))
    assert {r[0] for r in held(spark, out)} == {"a", "b", "c"}
    # The dataset that hasn't grown was left alone; a start without new files writes nothing.
    after = files(tmp_path / "out")
    assert b_files and {k: v for k, v in after.items() if "dataset_id=b" in k} == b_files
    assert ledger.run(spark, src, out, config) == 0
    assert files(tmp_path / "out") == after
    # Each row of the input is in one batch.
    parts = spark.read.schema(ledger.PARTS).parquet(f"{out}/parts")
    assert parts.select("batch").distinct().count() == 5


def test_ledger_forgets_ions_that_fall_below(spark, config, tmp_path):
    rng = random.Random(6)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, planted("a", range(6), rng), src)
    ledger.run(spark, src, out, config)
    assert len(held(spark, out)) == 3
    write(spark, planted("a", range(6, 40), rng, ()), src)
    ledger.run(spark, src, out, config)
    assert held(spark, out) == [] and spark.read.parquet(f"{out}/datasets").select("n_ions", "n_pixels").first()[:] == (0, 40)


@pytest.mark.parametrize("dies", ["before the fold", "between ions and marks", "within a batch"])
def test_ledger_after_a_failure(spark, config, tmp_path, monkeypatch, dies):
    rng = random.Random(7)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    lines = [planted("a", range(10), rng), planted("a", range(10, 18), rng, (200.0, 450.0))]
    write(spark, lines[0], src)
    ledger.run(spark, src, out, config)
    write(spark, lines[1], src)
    if dies == "before the fold":
        monkeypatch.setattr(ledger, "fold", lambda *a: 1 / 0)
    else:
        real, at = ledger.write_by_dataset, "/datasets" if "marks" in dies else "/parts"

        def once(df, path, *rest):
            if path.endswith(at):
                if at == "/parts":  # the batch's rows are there, its end isn't on record
                    real(df, path, *rest)
                raise ZeroDivisionError
            real(df, path, *rest)

        monkeypatch.setattr(ledger, "write_by_dataset", once)
    with pytest.raises(Exception):  # noqa: B017 (within a stream it comes as another kind)
        ledger.run(spark, src, out, config)
    monkeypatch.undo()
    assert held(spark, out) in ([], expected(spark, lines[0]))
    ledger.run(spark, src, out, config)
    assert held(spark, out) == expected(spark, sum(lines, []))


def test_ledger_of_nothing(spark, config, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    write(spark, [], src)
    assert ledger.run(spark, src, out, config) == 0 and held(spark, out) == []
    write(spark, [(None, None, None, None, None)], src)
    assert ledger.run(spark, src, out, config) == 1 and held(spark, out) == []
    write(spark, planted(None, range(6), random.Random(2)), src)
    ledger.run(spark, src, out, config)
    assert {r[0] for r in held(spark, out)} == {UNNAMED} and len(held(spark, out)) == 3


@pytest.mark.parametrize("kind", ["json", "csv", "orc"])
def test_other_formats(spark, config, tmp_path, kind):
    """Both jobs over files of other formats, text ones with a stated schema; the stream takes later files of a folder."""
    rng = random.Random(9)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    lines = [planted("a", range(8), rng), planted("a", range(8, 14), rng, (200.0, 450.0))]
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").format(kind).save(src)
    config |= {"format": kind} | ({} if kind == "orc" else {"schema": SCHEMA})
    put(lines[0])
    assert ledger.run(spark, src, out, config) == len(lines[0])
    put(lines[1])
    assert ledger.run(spark, src, out, config) == len(lines[1])
    assert held(spark, out) == expected(spark, sum(lines, []))
    assert qc.run(spark, src, f"{out}-qc", config)["peaks"] == len(sum(lines, [])) and qc.read_pixels(spark, f"{out}-qc").count() == 14


def test_jobs_leave_no_scratch(spark, config, tmp_path):
    src, shared = f"file://{tmp_path}/in", shared_dir(spark).removeprefix("file://")
    write(spark, planted("a", range(8), random.Random(10)), src)
    before = set(os.listdir(shared))
    qc.run(spark, src, f"file://{tmp_path}/qc", config)
    ledger.run(spark, src, f"file://{tmp_path}/ledger", config)
    assert set(os.listdir(shared)) == before
    with pytest.raises(KeyError):
        qc.run(spark, src, f"file://{tmp_path}/qc", {k: v for k, v in config.items() if k != "snr_mad"})
    assert set(os.listdir(shared)) == before
    assert qc.read_pixels(spark, f"file://{tmp_path}/qc").count() == 8


def test_command_lines(spark, config, tmp_path):
    src, conf = f"file://{tmp_path}/in", tmp_path / "own.json"
    write(spark, planted("a", range(10), random.Random(8)), src)
    conf.write_text(json.dumps({"columns": COLUMNS, "reference": REFERENCE}))
    for name in ("acquisition_qc", "reference_ledger"):
        env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", src, f"file://{tmp_path}/{name}", "--config", f"file://{conf}"], env=env, cwd=os.path.dirname(os.path.dirname(qc.__file__)), capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "wrote" in done.stderr and "read" in done.stderr
    assert qc.read_pixels(spark, f"file://{tmp_path}/acquisition_qc").count() == 10
    assert len(held(spark, f"file://{tmp_path}/reference_ledger")) == 3


def test_jobs_stand_alone():
    import jobs

    folder = os.path.dirname(jobs.__file__)
    for f in os.listdir(folder):
        if f.endswith(".py"):
            text = open(os.path.join(folder, f)).read()
            assert "ionweave.llm" not in text and "corpus_pipeline" not in text
    assert exists is not None

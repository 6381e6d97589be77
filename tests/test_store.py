"""Results that outlive the session: only changed nodes run again, unfinished entries don't count, old ones go."""

from __future__ import annotations

import dataclasses
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave import model as M
from ionweave.operators.pick import SnrParams
from ionweave.operators.tolerance import ToleranceParams
from ionweave.plans import pipeline
from ionweave.plans.store import Store, fingerprint
from ionweave.sources import load, native


def dataset(spark, seed=1, order=1):
    rng = np.random.default_rng(seed)
    rows = [("a", p, k, m * (1 + rng.normal() * 5e-6), float(rng.uniform(500, 1500))) for p in range(25) for k, m in enumerate((200.0, 250.0, 300.0, 350.0, 400.0))]
    pixels, shape = M.pixels_of(spark.createDataFrame([("a", p, p % 5 + 1, p // 5 + 1) for p in range(25)], "dataset_id string, pixel_id long, x int, y int"))
    ep = M.ExperimentParams("tof_reflectron", "maldi", "centroided", "negative", 150.0, 450.0, 50.0)
    return M.MsiDataset(pixels, peaks=spark.createDataFrame(rows[::order], M.PEAKS), grid_shape=shape, metadata=ep)


def chain(ds, snr=0.1):
    p = pipeline.chain(ds.metadata, [("ref", "detect_reference_ions"), ("tol", "empirical_tolerance_from_reference_ions"), ("norm", "median_normalize"), ("pick", "snr_peak_pick")], 3)
    return p.replace("tol", params=ToleranceParams(bootstrap_B=3)).replace("pick", params=SnrParams(snr_mad=snr))


def test_a_second_session_runs_changed_nodes(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = pipeline.Runner(Store(spark, folder))
    ds = dataset(spark)
    a = first.run(ds, chain(ds))
    assert first.executed == ["ref", "tol", "norm", "pick"]
    # Another session reads the same data anew, its rows in another order.
    again = dataset(spark, order=-1)
    second = pipeline.Runner(Store(spark, folder))
    b = second.run(again, chain(again))
    assert second.executed == [] and b.summaries() == a.summaries() and b.dataset.hash() == a.dataset.hash()
    rows = lambda r: sorted(tuple(x) for x in r.dataset.peaks.select(*M.PIXEL, "peak_idx", "mz", "intensity").collect())
    assert rows(a) == rows(b) and b.results["ref"].diagnostics[0].payload["ref_ions"].count() == a.results["ref"].dataset.extras["ref_ions"].count() > 0 and b.results["ref"].dataset.extras["ref_obs"].exceptAll(a.results["ref"].dataset.extras["ref_obs"]).isEmpty()
    third = pipeline.Runner(Store(spark, folder))
    third.run(dataset(spark), chain(ds, 0.2))
    assert third.executed == ["pick"]
    other = dataset(spark, seed=2)
    third.run(other, chain(other))
    assert third.executed == ["ref", "tol", "norm", "pick"]
    assert len(Store(spark, folder).keys()) == 9


def test_unfinished_entries_and_eviction(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    ds = dataset(spark)
    assert store.keys() == [] and store.get("x") is None and store.evict(3) == []
    result = pipeline.Runner().run(ds, chain(ds)).results["norm"]
    real = native.write
    with monkeypatch.context() as m:  # a writer that dies after the tables
        m.setattr(native, "write", lambda d, f: (real(d, f), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.put("k0", result)
    assert store.get("k0") is None and len(os.listdir(tmp_path / "store")) == 1
    for k in range(3):
        store.put(f"k{k}", result)
        os.utime(tmp_path / "store" / f"k{k}", (1000 + k, 1000 + k))
    assert store.put("k2", result).dataset.peaks.count() == 125  # written twice: the first stands
    os.utime(tmp_path / "store" / "k2", (1002, 1002))
    assert store.keys() == ["k2", "k1", "k0"] and store.evict(2) == ["k0"]
    assert sorted(f for f in os.listdir(tmp_path / "store") if not f.endswith(".crc")) == ["k1", "k2"]


def test_fingerprints(spark):
    ds = dataset(spark)
    same = fingerprint(ds)
    assert fingerprint(dataset(spark, order=-1)) == same
    moved = ds.with_(peaks=ds.peaks.withColumn("mz", F.when((F.col("pixel_id") == 3) & (F.col("peak_idx") == 0), F.col("mz") + 1e-9).otherwise(F.col("mz"))))
    twice = ds.with_(peaks=ds.peaks.unionByName(ds.peaks.limit(1)))
    others = [moved, twice, ds.with_(rng_seed=4), ds.with_rois(M.RoiDef("r", ((0, 0), (0, 2), (2, 2)))), ds.with_(metadata=dataclasses.replace(ds.metadata, polarity="positive")), ds.with_extras(ref=ds.peaks)]
    assert len({same, *map(fingerprint, others)}) == 7
    known = ds.with_(identity=M.DatasetIdentity("f", "abc"))
    assert fingerprint(known) == fingerprint(moved.with_(identity=M.DatasetIdentity("f", "abc"))) != same


def test_runners_without_a_store(spark):
    """Two inputs of equal description are told apart, also when the first is gone."""
    r = pipeline.Runner()
    p = chain(dataset(spark))
    for seed in (1, 2, 3):
        ds = dataset(spark, seed)
        r.run(ds, p)
        assert len(r.executed) == 4
        r.run(ds, p)
        assert r.executed == []
        del ds


def test_saving_over_the_source(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    native.write(dataset(spark), path)
    read = load.load(spark, path)
    native.write(read.with_(peaks=read.peaks.where("mz < 260")), path)
    assert load.load(spark, path).peaks.count() == 50 and sorted(os.listdir(tmp_path)) == ["d"]

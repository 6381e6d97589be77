"""Operators on planted data, the data model, pipelines and readers and writers."""

import dataclasses
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave import model as M
from ionweave.cli import apply_spec, cohort_align
from ionweave.functions import axis, exprs, grid, stats
from ionweave.operators import names, operator
from ionweave.operators import background, bootstrap, consensus, cwt, dbscan, hot_pixel, moran, normalize, pick, prevalence, recalibrate, reference_ions, tolerance
from ionweave.plans import cohort, diagnostics, pipeline, views
from ionweave.sources import andi, imzml, load, netcdf3, sidecar, spec, tiff

PLANTED = [200.0, 250.0, 300.0, 350.0, 400.0]


def synthetic(spark, seed=42, side=5, name="a", zeros=False, params=None):
    """25 pixels of five planted peaks with 5 ppm jitter and intensities about 1000."""
    rng = np.random.default_rng(seed)
    rows, coords = [], []
    for p in range(side * side):
        coords.append((name, p, p % side + 1, p // side + 1))
        for k, m in enumerate(PLANTED):
            mz = m * (1 + rng.normal() * 5e-6)
            if zeros:
                rows += [(name, p, 10 * k + j, mz - 0.01 * (2 - j), 0.0) for j in range(2)]
            rows.append((name, p, 10 * k + 5, mz, float(max(1, rng.normal(1000, 100)))))
    pixels, shape = M.pixels_of(spark.createDataFrame(coords, "dataset_id string, pixel_id long, x int, y int"))
    ep = params or M.ExperimentParams("tof_reflectron", "maldi", "centroided", "negative", 150.0, 450.0, 50.0)
    return M.MsiDataset(pixels, peaks=spark.createDataFrame(rows, M.PEAKS), grid_shape=shape, metadata=ep)


@pytest.fixture(scope="module")
def ds(spark):
    return synthetic(spark)


@pytest.fixture(scope="module")
def with_refs(ds):
    return operator("detect_reference_ions").apply(ds, reference_ions.ReferenceIonParams(coarse_tol_ppm=100.0)).dataset


@pytest.fixture(scope="module")
def aligned(ds):
    p = consensus.KdeParams(bandwidth_ppm=20.0, default_tol_ppm=200.0, min_prevalence=0.3)
    return operator("kde_consensus_alignment").apply(ds, p).dataset


def test_registry():
    assert len(names()) == 15
    with pytest.raises(KeyError):
        operator("nothing")


def test_model(spark):
    with pytest.raises(ValueError):
        M.ExperimentParams(mz_min=2.0, mz_max=1.0)
    with pytest.raises(ValueError):
        M.ExperimentParams(instrument_family="scale")
    with pytest.raises(ValueError):
        M.RoiDef("x", ((0, 0), (1, 1)))
    assert M.hash_obj({"b": 1, "a": [1, 2]}) == M.hash_obj({"a": [1, 2], "b": 1}) and len(M.hash_obj(1)) == 64
    assert M.combine_hashes("a", "b") != M.combine_hashes("b", "a")
    values, source = M.merge_metadata(("user", {"polarity": "negative"}), ("imzml", {"polarity": "positive", "mz_max": 9.0, "other": 1}))
    assert (values["polarity"], source["polarity"], source["mz_max"], source["notes"]) == ("negative", "user", "imzml", "default")
    for rows, idx in (([(0, 1, 1), (1, 3, 2)], [0, 5]), ([(0, 0, 0), (1, 2, 1)], [0, 5])):
        p, shape = M.pixels_of(spark.createDataFrame([("a", *r) for r in rows], "dataset_id string, pixel_id long, x int, y int"))
        assert [r.grid_idx for r in p.orderBy("pixel_id").collect()] == idx and shape == (2, 3)
    with pytest.raises(ValueError):
        M.pixels_of(spark.createDataFrame([("a", 0, 9, 1)], "dataset_id string, pixel_id long, x int, y int"), (2, 3))


def test_reductions(spark):
    flat = [(0, 10.0), (0, 100.0), (1, 20.0), (1, 200.0), (2, 30.0), (2, 300.0), (2, 999.0), (3, 0.0), (3, 5.0)]
    peaks = spark.createDataFrame([("a", p, k, 100.0 + k, i) for k, (p, i) in enumerate(flat)], M.PEAKS)
    get = lambda kind: [r.value for r in views.per_pixel_reduce(peaks, kind).orderBy("pixel_id").collect()]
    assert get("sum") == [110, 220, 1329, 5] and get("max") == [100, 200, 999, 5] and get("count") == [2, 2, 3, 2]
    assert get("mean")[3] == 5 and get("median")[2] == 300 and get("rms")[3] == 5


def test_zeros_are_skipped(spark):
    z, plain = synthetic(spark, zeros=True), synthetic(spark)
    for kind in ("median", "rms", "tic"):
        a = [r.value for r in views.project(z, kind).orderBy("pixel_id").collect()]
        b = [r.value for r in views.project(plain, kind).orderBy("pixel_id").collect()]
        assert a == pytest.approx(b)


def test_reference_ions(with_refs):
    refs = with_refs.extras["ref_ions"].orderBy("mz").collect()
    assert [r.mz for r in refs] == pytest.approx(PLANTED, rel=1e-5) and all(r.prevalence == 1.0 for r in refs)
    assert with_refs.extras["ref_obs"].agg(F.max(F.abs("ppm_error"))).first()[0] < 30


def test_isotonic_and_lerp(spark):
    df = spark.createDataFrame([([5.0, 3.0, 4.0, 2.0, 6.0],), ([1.0, 2.0],)], "y array<double>")
    got = df.select(exprs.running_sums(F.col("y")).alias("s")).select(exprs.isotonic(F.col("s")).alias("i")).collect()
    assert got[0].i == pytest.approx([3.5, 3.5, 3.5, 3.5, 6.0]) and got[1].i == [1.0, 2.0]
    xs, ys = F.array(*map(F.lit, (1.0, 2.0, 4.0))), F.array(*map(F.lit, (10.0, 20.0, 0.0)))
    q = [0.5, 1.0, 1.5, 2.0, 3.0, 9.0]
    got = spark.createDataFrame([(x,) for x in q], "x double").select(exprs.lerp("x", xs, ys).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx(list(np.interp(q, [1, 2, 4], [10, 20, 0])))


def test_tolerance(with_refs):
    out = operator("empirical_tolerance_from_reference_ions").apply(with_refs, tolerance.ToleranceParams(bootstrap_B=5, block_size_pixels=4)).dataset
    c = out.extras["tolerance_curve"].orderBy("i").collect()
    assert len(c) == 200 and all(a.ppm_quantile <= b.ppm_quantile + 1e-9 for a, b in zip(c, c[1:], strict=False))
    assert all(r.ci_low <= r.ci_high for r in c) and 5 < c[-1].ppm_quantile < 30
    few = with_refs.with_extras(ref_ions=with_refs.extras["ref_ions"].limit(2))
    flat = tolerance.tolerance_curve(few.extras["ref_ions"], few.extras["ref_obs"], few.pixels, tolerance.ToleranceParams(bootstrap_B=0)).collect()
    assert len({r.ppm_quantile for r in flat}) == 1 and len(flat) == 200


def test_recalibration(spark, ds):
    # Each pixel is off by up to 80 ppm; both methods bring the peaks back.
    off = F.pmod(F.col("pixel_id") * 37, F.lit(161)) - 80
    bad = ds.with_peaks(ds.peaks.withColumn("mz", F.col("mz") * (1 + off * F.lit(1e-6))))
    found = operator("detect_reference_ions").apply(bad, reference_ions.ReferenceIonParams(coarse_tol_ppm=400.0)).dataset
    spread = lambda d: d.peaks.groupBy(F.round("mz")).agg((F.stddev("mz") / F.avg("mz") * 1e6).alias("s")).agg(F.max("s")).first()[0]
    before = spread(bad)
    w = operator("msiwarp_recalibrate").apply(found, recalibrate.WarpParams(ransac_threshold_ppm=40.0))
    lock = operator("lock_mass_recalibrate").apply(found)
    assert before > 30 and spread(w.dataset) < 12 and spread(lock.dataset) < 12
    assert w.diagnostics[0].values()["fraction_pixels_recalibrated"] == 1.0
    with pytest.raises(ValueError):
        recalibrate.LockMassParams("closest_to_mz")
    with pytest.raises(RuntimeError):
        operator("msiwarp_recalibrate").apply(ds)


def test_normalisation_and_picking(ds, with_refs):
    tic = operator("tic_normalize").apply(ds).dataset
    assert [r.value for r in views.project(tic, "tic").collect()] == pytest.approx([1.0] * 25)
    med = operator("median_normalize").apply(ds).dataset
    assert [r.value for r in views.project(med, "median").collect()] == pytest.approx([1.0] * 25)
    ref = operator("reference_ion_normalize").apply(with_refs).dataset
    assert [r.value for r in views.project(ref, "tic").collect()] == pytest.approx([1.0] * 25)
    with pytest.raises(RuntimeError):
        operator("reference_ion_normalize").apply(ds)
    assert operator("snr_peak_pick").apply(ds, pick.SnrParams(snr_mad=0.0)).dataset.peaks.count() == 125
    assert operator("snr_peak_pick").apply(ds, pick.SnrParams(min_intensity_abs=1000.0)).dataset.peaks.agg(F.min("intensity")).first()[0] > 1000


def plain_cwt_peaks(y, widths, min_snr, noise_perc):
    """The published method, with lists: a line is [scales, places, gap]."""
    n = len(y)
    c = []
    for w in widths:
        points = min(10 * w, n)
        x = np.arange(0, points) - (points - 1) / 2
        kernel = 2 / (math.sqrt(3 * w) * math.pi**0.25) * (1 - (x / w) ** 2) * np.exp(-(x**2) / (2 * w**2))
        full = [sum(y[j] * kernel[::-1][i - j] for j in range(max(0, i - len(kernel) + 1), min(n, i + 1))) for i in range(n + len(kernel) - 1)]
        start = (len(full) - n) // 2
        c.append(full[start : start + n])
    c = np.array(c)
    tops = [[i for i in range(1, n - 1) if r[i] > r[i - 1] and r[i] > r[i + 1]] for r in c]
    some = [k for k, t in enumerate(tops) if t]
    if not some:
        return []
    live, done = [[[some[-1]], [i], 0] for i in tops[some[-1]]], []
    for k in range(some[-1] - 1, -1, -1):
        for x in live:
            x[2] += 1
        before = [x[1][-1] for x in live]
        for i in tops[k]:
            near = min(range(len(before)), key=lambda j: abs(before[j] - i)) if before else None
            if near is not None and abs(before[near] - i) <= widths[k] / 4:
                live[near][0].append(k)
                live[near][1].append(i)
                live[near][2] = 0
            else:
                live.append([[k], [i], 0])
        done += [x for x in live if x[2] > math.ceil(widths[0])]
        live = [x for x in live if x[2] <= math.ceil(widths[0])]
    out = []
    half, odd = divmod(math.ceil(n / 20), 2)
    for scales, at, _ in done + live:
        i = at[-1]
        noise = np.percentile(c[0][max(i - half, 0) : min(i + half + odd, n)], noise_perc)
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(scales) >= math.ceil(len(widths) / 4) and not abs(np.float64(c[scales[-1], i]) / noise) < min_snr:
                out.append(i)
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_wavelet_peaks_are_those_of_the_plain_method(seed):
    rng = np.random.default_rng(seed)
    n = [60, 130, 200, 90, 40, 150, 30, 77][seed]
    x = np.arange(n)
    y = np.zeros(n) if seed % 3 == 0 else np.abs(rng.normal(0.3, 0.1, n))
    for _ in range(seed + 1):
        y = y + rng.uniform(1, 9) * np.exp(-(((x - rng.uniform(0, n)) / rng.uniform(1, 5)) ** 2))
    y[rng.random(n) < 0.1] = 0.0
    y = np.round(y, 3)  # ties
    for widths, snr in ((np.linspace(1, 8, 6), 1.0), (np.linspace(2.3, 12.7, 9), 3.0), (np.array([1.0]), 0.5)):
        assert cwt.places(y, widths, snr, 10.0).tolist() == plain_cwt_peaks(y, widths, snr, 10.0)
    assert cwt.places(np.zeros(n), np.linspace(1, 8, 6), 1.0, 10.0).tolist() == []


def test_planted_profile_spectra(spark):
    """25 spectra of three peaks over a floor, with the default widths of their instrument."""
    rng = np.random.default_rng(123)
    grid = np.linspace(150.0, 450.0, 1024)
    rows = []
    for p in range(25):
        y = rng.normal(0.5, 0.05, 1024).clip(min=0)
        for m in (200.0, 300.0, 400.0):
            y = y + (30 + 5 * rng.normal()) * np.exp(-((grid - m) ** 2) / (2 * (0.05 / 2.355) ** 2))
        rows += [("a", p, k, float(m), float(v)) for k, (m, v) in enumerate(zip(grid, y))]
    pixels, shape = M.pixels_of(spark.createDataFrame([("a", p, p % 5 + 1, p // 5 + 1) for p in range(25)], "dataset_id string, pixel_id long, x int, y int"))
    d = M.MsiDataset(pixels, peaks=spark.createDataFrame(rows, M.PEAKS), grid_shape=shape, metadata=M.ExperimentParams("qtof", "esi", "profile", "positive", 150.0, 450.0))
    out = operator("cwt_peak_pick").apply(d, cwt.CwtParams(width_min_ppm=500.0, width_max_ppm=3000.0, n_widths=8, grid_ppm_step=250.0, min_snr=2.0))
    got = [(r.pixel_id, r.mz) for r in out.dataset.peaks.where("intensity > 5").collect()]
    for m in (200.0, 300.0, 400.0):
        seen = {p for p, x in got if abs(x - m) < 0.5}
        planted = {p for p in range(25) if max(v for _, q, _, x, v in rows if q == p and abs(x - m) < 0.2) > 6}
        assert planted <= seen
    values = out.diagnostics[0].values()
    assert values["n_pixels"] == 25 and values["n_widths"] == 8 and values["n_peaks_total"] == out.dataset.peaks.count() and values["grid_size"] == len(cwt.grid_of(150.0, 450.0, cwt.CwtParams(grid_ppm_step=250.0))[0])


def test_cwt(spark):
    rng = np.random.default_rng(123)
    mz = np.linspace(150, 450, 1024)
    p = cwt.CwtParams(width_min_ppm=200, width_max_ppm=1500, n_widths=8, grid_ppm_step=100, min_snr=3)
    y = np.maximum(rng.normal(0.5, 0.05, 1024), 0) + sum(30 * np.exp(-0.5 * ((mz - c) / 0.4) ** 2) for c in (200, 300, 400))
    df = spark.createDataFrame([("a", 0, mz.tolist(), y.tolist())], "dataset_id string, pixel_id long, mz array<double>, intensity array<double>")
    got = [r.mz for r in cwt.cwt_pick(df, 150.0, 450.0, p).where("intensity > 15").collect()]
    assert all(min(abs(m - c) for m in got) < 0.5 for c in (200, 300, 400))
    assert all(min(abs(m - c) for c in (200, 300, 400)) < 2 for m in got)


def test_alignment(ds, aligned):
    ch = aligned.channels.orderBy("channel").collect()
    assert [c.mz for c in ch] == pytest.approx(PLANTED, rel=1e-4) and all(c.prevalence == 1.0 and c.n_peaks == 25 for c in ch)
    assert aligned.cells.count() == 125
    db = operator("dbscan_consensus").apply(ds, dbscan.DbscanParams(eps_ppm=30.0)).dataset
    assert abs(db.channels.count() - 5) <= 2
    with pytest.raises(RuntimeError):
        operator("kde_consensus_alignment").apply(ds, consensus.KdeParams(default_tol_ppm=0.001, min_prevalence=0.9))


def brute_dbscan(x, eps, k):
    near = [[j for j in range(len(x)) if abs(x[i] - x[j]) <= eps] for i in range(len(x))]
    core, label, c = [len(n) >= k for n in near], [-1] * len(x), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = c
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = c
                        if core[j]:
                            todo.append(j)
            c += 1
    return label


def test_dbscan_is_exact(spark):
    rng = np.random.default_rng(0)
    for k in (2, 4):
        mz = np.exp(np.round(rng.uniform(5, 5.002, 120), 6))
        peaks = spark.createDataFrame([("a", i, 0, float(m), 1.0) for i, m in enumerate(mz)], M.PEAKS)
        got = {r.pixel_id: r.cluster for r in dbscan.dbscan(peaks, 1.55e-5, k).collect()}
        want = brute_dbscan(np.log(mz), 1.55e-5, k)
        assert {i for i, c in enumerate(want) if c >= 0} == set(got)
        assert len({(want[i], c) for i, c in got.items()}) == len(set(got.values()))


@pytest.mark.parametrize("k", [1, 3, 8])
def test_dbscan_with_full_cells(spark, k):
    """One ion with most of the points, many at the same m/z, and stragglers at all distances from it: full cells are
    core by their counts, those beside them look at the nearest of their points."""
    rng = np.random.default_rng(k)
    eps = 1.55e-5
    x = np.concatenate([rng.normal(5.5, 0.4 * eps, 350), np.full(60, 5.5 + 2.3 * eps), 5.5 + eps * rng.uniform(-9, 9, 60), 5.5 + eps * (np.arange(-12, 13) * 0.5 + 0.01), rng.uniform(5.49, 5.51, 40)])
    x = rng.permutation(x)
    peaks = spark.createDataFrame([("a", i, 0, float(math.exp(v)), 1.0) for i, v in enumerate(x)], M.PEAKS).repartition(5)
    got = {r.pixel_id: r.cluster for r in dbscan.dbscan(peaks, eps, k).collect()}
    want = brute_dbscan(np.log(np.exp(x)), eps, k)
    assert {i for i, c in enumerate(want) if c >= 0} == set(got)
    assert len({(want[i], c) for i, c in got.items()}) == len(set(got.values())) == max(want) + 1


def test_two_nearest_assignment_and_ties(spark):
    ax = spark.createDataFrame([("a", i, m, m - 1.5, m + 1.5) for i, m in enumerate([100.0, 101.0, 102.0])], "dataset_id string, channel int, mz double, lo double, hi double")
    p = spark.createDataFrame([("a", 0, 0, m, 1.0) for m in (99.0, 100.5, 101.0, 103.4, 104.0)], M.PEAKS)
    got = sorted((r.mz, r.channel) for r in axis.assign(p, ax).collect())
    assert got == [(99.0, 0), (100.5, 0), (100.5, 1), (101.0, 0), (101.0, 1), (103.4, 2)]
    near = sorted((r.mz, r.channel) for r in axis.nearest(p, ax).collect())
    assert near == [(99.0, 0), (100.5, 0), (101.0, 1), (103.4, 2), (104.0, 2)]
    plan = axis.assign(p, ax)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def matrix(spark, images, width):
    """Dense images (channel -> values by pixel) as a dataset."""
    n = len(images[0])
    coords = spark.createDataFrame([("a", i, i % width, i // width) for i in range(n)], "dataset_id string, pixel_id long, x int, y int")
    pixels, shape = M.pixels_of(coords)
    cells = spark.createDataFrame([("a", p, c, float(v)) for c, img in enumerate(images) for p, v in enumerate(img) if v > 0], "dataset_id string, pixel_id long, channel int, intensity double")
    channels = spark.createDataFrame([("a", c, 100.0 + c, float(np.mean(np.array(img) > 0)), int(np.sum(np.array(img) > 0))) for c, img in enumerate(images)], "dataset_id string, channel int, mz double, prevalence double, n_peaks long")
    return M.MsiDataset(pixels, cells=cells, channels=channels, grid_shape=shape)


def test_moran(spark):
    rng = np.random.default_rng(1)
    half = np.where(np.arange(256) % 16 < 8, 1.0, 0.05) + np.abs(rng.normal(0, 0.05, 256))
    d = matrix(spark, [half, np.abs(rng.normal(1, 0.2, 256)), np.ones(256)], 16)
    t = {r.channel: r for r in moran.moran_test(d.cells, d.channels, d.pixels, moran.MoranParams(n_permutations=39, q_threshold=0.1)).collect()}
    assert t[0].i > 0.8 and t[0].kept and abs(t[1].i) < 0.2 and not t[1].kept and t[2].i == 0
    x, m = half, half.mean()
    pairs = [(i, j) for i in range(256) for j in range(256) if i != j and abs(i % 16 - j % 16) <= 1 and abs(i // 16 - j // 16) <= 1]
    want = 256 / len(pairs) * sum((x[i] - m) * (x[j] - m) for i, j in pairs) / ((x - m) ** 2).sum()
    assert t[0].i == pytest.approx(want)
    small = matrix(spark, [[1.0, 0, 2.0, 3.0]], 2)
    assert operator("morans_i_permutation").apply(small).dataset.channels.count() == 1


def test_prevalence(spark):
    assert stats.occupancy_tail(10, 0, 3) == 1.0 and stats.occupancy_tail(5, 3, 4) == 0.0
    want = sum(len(set(map(int, np.base_repr(i, 3).zfill(4)))) >= 3 for i in range(81)) / 81
    assert stats.occupancy_tail(3, 4, 3) == pytest.approx(want)
    rng = np.random.default_rng(2)
    d = matrix(spark, [rng.random(200) < f for f in (0.95, 0.95, 0.5, 0.5)], 20)
    d = d.with_(channels=d.channels.withColumn("n_peaks", F.lit(200).cast("bigint")))
    out = operator("prevalence_fdr_filter").apply(d).dataset
    assert [r.mz for r in out.channels.orderBy("mz").collect()] == [100.0, 101.0]


def test_hot_pixels(spark, ds):
    hot = ds.with_peaks(ds.peaks.withColumn("intensity", F.when(F.col("pixel_id") == 12, F.col("intensity") * 100).otherwise(F.col("intensity"))))
    out = operator("hot_pixel_filter").apply(hot)
    assert [r.pixel_id for r in out.dataset.extras["hot_pixels"].collect()] == [12]
    t = {r.pixel_id: r.value for r in views.project(out.dataset, "tic").collect()}
    assert t[12] == pytest.approx(np.median([t[i] for i in (6, 7, 8, 11, 13, 16, 17, 18)]))
    zero = operator("hot_pixel_filter").apply(hot, hot_pixel.HotPixelParams(correction="zero")).dataset
    assert {r.pixel_id: r.value for r in views.project(zero, "tic").collect()}[12] == 0


def test_regions_and_background(aligned):
    fg, bg = M.RoiDef("t", ((0, 0), (0, 2.5), (2.5, 2.5), (2.5, 0))), M.RoiDef("b", ((3, 3), (3, 4.5), (4.5, 4.5), (4.5, 3)), True)
    assert grid.roi_pixels(aligned.pixels, fg).count() == 9 and grid.roi_pixels(aligned.pixels, bg).count() == 4
    d = aligned.with_rois(fg, bg)
    op = operator("background_subtract")
    with pytest.raises(RuntimeError):
        op.apply(aligned)
    assert op.apply(d, background.BackgroundParams(bg_to_fg_ratio_threshold=9.0)).dataset.channels.count() == 5
    sub = op.apply(d, background.BackgroundParams(mode="subtract")).dataset
    assert sub.cells.agg(F.max("intensity")).first()[0] < 600
    with pytest.raises(RuntimeError):
        op.apply(d, background.BackgroundParams(bg_to_fg_ratio_threshold=0.01))
    spec_ = {r.channel: r.value for r in views.roi_matrix_spectrum(d, [fg], "mean").collect()}
    assert 900 < spec_[0] < 1100


def test_cohort(spark):
    both = cohort.union([synthetic(spark), synthetic(spark, seed=43, name="b")])
    r = cohort.align_cohort(both, cohort.CohortParams(bandwidth_ppm=20.0, default_tol_ppm=200.0, snr_mad=0.0, bootstrap_B=0, reference=reference_ions.ReferenceIonParams(coarse_tol_ppm=100.0)))
    mz = [x.mz for x in r.axis.orderBy("channel").collect()]
    assert len(mz) >= 5 and all(min(abs(m / p - 1) for m in mz) < 200e-6 for p in PLANTED)
    assert r.per_dataset.select("dataset_id").distinct().count() == 2


def test_pipeline_rules():
    ep = M.ExperimentParams("tof_reflectron", "maldi", "centroided", sample_type="tissue")
    p = pipeline.recommend(ep)
    assert [n.op_name for n in p.nodes][2] == "msiwarp_recalibrate" and p.nodes[-1].op_name == "morans_i_permutation"
    q = pipeline.recommend(M.ExperimentParams("orbitrap", profile_or_centroided="profile"))
    assert "msiwarp_recalibrate" not in [n.op_name for n in q.nodes] and "cwt_peak_pick" in [n.op_name for n in q.nodes]
    for nodes in ((pipeline.Node("a", "x"), pipeline.Node("a", "x")), (pipeline.Node("a", "x", None, ("b",)),), (pipeline.Node("a", "x", None, ("b",)), pipeline.Node("b", "x"))):
        with pytest.raises(ValueError):
            pipeline.Pipeline(nodes)
    v = pipeline.with_optional(pipeline.with_variant(p, "norm", "tic_normalize", ep), "hot_pixel_filter", ep)
    assert v.nodes[0].op_name == "hot_pixel_filter" and v.nodes[1].upstream == ("hot_pixel_filter",) and v.node("norm").op_name == "tic_normalize"
    with pytest.raises(ValueError):
        pipeline.with_variant(p, "norm", "snr_peak_pick", ep)
    assert p.hash() != v.hash() and pipeline.node_seed(1, "a") != pipeline.node_seed(1, "b")


def test_runner_cache(ds):
    p = pipeline.chain(ds.metadata, [("norm", "median_normalize"), ("pick", "snr_peak_pick")], 0)
    r = pipeline.Runner()
    first = r.run(ds, p)
    assert r.executed == ["norm", "pick"] and len(first.dataset.history) == 2
    r.run(ds, p)
    assert r.executed == []
    r.run(ds, p.replace("pick", params=pick.SnrParams(snr_mad=1.0)))
    assert r.executed == ["pick"]


def test_grades():
    assert [diagnostics.grade("n_reference_ions", v) for v in (2, 4, 5)] == ["bad", "warn", "ok"]
    assert [diagnostics.grade("fraction_noise", v) for v in (0.4, 0.6, 0.8)] == ["ok", "warn", "bad"]
    text = diagnostics.text({"ref": {"n_reference_ions": 2.0, "x": math.nan}}, {"ref": "detect_reference_ions"})
    assert "Reference ions" in text and diagnostics.MARKS["bad"] in text
    assert diagnostics.watch_list({"a": {"n_reference_ions": 4.0, "prevalence_min": 0.1}})[0][1] == "prevalence_min"


def test_views(aligned):
    assert views.top_channels(aligned, 2).count() == 2
    assert views.nearest_channel(aligned, 310).first().channel == 2
    assert views.channel_image(aligned, 0).count() == 25
    assert views.pixel_spectrum(aligned, 1, 1).count() == 5
    h = views.histogram(aligned.channels, "mz", 4).orderBy("bin").collect()
    assert [x.n for x in h] == list(np.histogram([r.mz for r in aligned.channels.collect()], 4)[0])
    assert views.contrast(views.project(aligned, "tic")).first().low > 0


@pytest.mark.parametrize("block", [None, 9])
def test_bootstrap_as_vectors_and_as_rows(spark, monkeypatch, block):
    """The replicates' curves are those of pairs repeated as rows: pixels without pairs, few pairs, rare
    anchors, ties of errors, replicates that aren't a multiple of a vector's length."""
    rng = np.random.default_rng(8)
    coords, pairs = [], []
    for name, side, refs, share in (("a", 8, 12, 0.9), ("b", 5, 4, 0.5), ("c", 3, 3, 0.3)):
        for k in range(side * side):
            coords.append((name, 3 * k + 1, k % side, k // side))
            for r in range(refs):
                if rng.random() < (share if r else 0.1):
                    pairs.append((name, 3 * k + 1, r, 100.0 + 7.3 * r, float(np.round(rng.gamma(2, 2 + r), 1))))
    pixels, _ = M.pixels_of(spark.createDataFrame(coords, "dataset_id string, pixel_id long, x int, y int"))
    pairs = spark.createDataFrame(pairs, "dataset_id string, pixel_id long, ref_id int, x double, y double")
    grid_df = pairs.groupBy("dataset_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = 23
    monkeypatch.setattr(bootstrap, "REPS", 10)
    m = bootstrap.multiplicities(pixels, n, 3, block, 8)
    reps = F.transform(F.sequence(F.lit(1), F.length("m")), lambda i: F.conv(F.hex(F.col("m").substr(i, F.lit(1))), 16, 10).cast("bigint"))
    rows = m.select("dataset_id", "pixel_id", "rb", F.posexplode(reps).alias("k", "m")).select("dataset_id", "pixel_id", (F.col("rb") + F.col("k")).alias("rep"), "m").where("m > 0")
    total = {(r.dataset_id, r.rep): r.m for r in rows.groupBy("dataset_id", "rep").agg(F.sum("m").alias("m")).collect()}
    assert total == {(d, r): s for d, s in (("a", 64), ("b", 25), ("c", 9)) for r in range(n)}
    for alpha in (0.01, 0.3):
        want = {(r.dataset_id, r.rep, r.i): r.ppm for r in tolerance.curve(pairs.join(rows, ["dataset_id", "pixel_id"]), alpha, ["dataset_id", "rep"], grid_df).collect()}
        got = {(r.dataset_id, r.rep, i): v for r in bootstrap.curves(pairs, grid_df, m, n, alpha).collect() for i, v in enumerate(r.ppm)}
        assert got.keys() == want.keys() and len({k[:2] for k in got}) >= 2 * n
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


@pytest.mark.parametrize("n, k", [(50, 30), (50, 200), (100, 100), (500, 560), (500, 20), (1000, 3), (2000, 2000), (3000, 100), (2000, 15000), (64, 1000), (2, 5), (1, 4), (7, 7)])
def test_occupancy_by_balls_and_by_integrals(n, k):
    middle = n * (1 - (1 - 1 / n) ** k)
    for obs in {1, 2, min(n, k), *(int(min(max(middle + d * math.sqrt(n), 1), min(n, k))) for d in (-3, -1, -0.3, 0, 0.3, 1, 2))}:
        if obs <= min(n, k):
            a, b = stats._tail_by_balls(n, k, obs), stats._tail_by_integrals(n, k, obs)
            assert b == pytest.approx(a, rel=1e-8, abs=1e-13), obs


def test_occupancy_of_large_images():
    """A million pixels; the sum of all probabilities is 1, and the mean is that of independent pixels."""
    n = k = 10**6
    middle, sd = n * (1 - math.exp(-1)), math.sqrt(n * (math.exp(-1) - 2 * math.exp(-2)))
    j = np.arange(int(middle - 12 * sd), int(middle + 12 * sd))
    p = np.exp(stats.occupancy_log(n, k, j))
    assert p.sum() == pytest.approx(1, abs=1e-6) and (p * j).sum() == pytest.approx(-n * math.expm1(k * math.log1p(-1 / n)), rel=1e-6)
    t = [stats.occupancy_tail(n, k, int(middle + d * sd)) for d in (-3, 0, 3)]
    assert t == pytest.approx([0.9987, 0.5, 0.00135], abs=2e-3) and stats.occupancy_tail(n, k, n) == 0.0


@pytest.mark.parametrize("n, ppm", [(32768, 50.0), (4000, 200.0), (1500, 300.0), (3000, 100.0), (900, 50.0)])
def test_density_is_the_sum_of_kernels(spark, n, ppm):
    """Fine and coarse grids: moments of offsets, many terms, and peaks spread one by one."""
    rng = np.random.default_rng(0)
    x, w = rng.uniform(math.log(200), math.log(700), 800), rng.uniform(0, 10, 800)
    df = spark.createDataFrame([("a", 0, i, float(m), float(v)) for i, (m, v) in enumerate(zip(np.exp(x), w))], M.PEAKS)
    p = consensus.KdeParams(n_grid_points=n, bandwidth_ppm=ppm)
    got = np.array([r.density for r in consensus.density(df, p).orderBy("g").collect()])
    x, bw = np.log(np.exp(x)), p.bandwidth
    lo, hi = x.min() - 5 * bw, x.max() + 5 * bw
    h = (hi - lo) / (n - 1)
    want = np.zeros(n)
    for xi, wi in zip(x, w):
        g = np.arange(max(0, math.ceil((xi - 5 * bw - lo) / h)), min(n - 1, math.floor((xi + 5 * bw - lo) / h)) + 1)
        want[g] += wi * np.exp(-0.5 * ((lo + g * h - xi) / bw) ** 2)
    want /= math.sqrt(2 * math.pi) * bw * w.sum()
    assert np.abs(got - want).max() < 1e-9 * want.max()


def test_keyed_draws_are_even():
    """Draws fill bins as independent ones would, and replicates differ."""
    n = 1000
    for what in ("pixels", "blocks"):
        m = np.stack([bootstrap.of_pixels(n, r, 7) if what == "pixels" else bootstrap.of_blocks(np.arange(n) // 10, r, 7) for r in range(200)])
        assert (m.sum(axis=1) == n).all() and abs(m.mean(axis=0) - 1).max() < 0.5
    share = np.mean([(bootstrap.of_pixels(n, r, 7) == 0).mean() for r in range(200)])
    assert abs(share - math.exp(-1)) < 0.005
    one, two = stats.keyed(np.arange(n), 0, 7), stats.keyed(np.arange(n), 1, 7)
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.1 and abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.1 and len(np.unique(one)) > 0.99 * n


def test_moran_in_memory_and_as_rows(spark, monkeypatch):
    """Both ways of permuting give the same counts: two datasets, holes in the grid, a constant channel, an
    empty one, several blocks of channels and of permutations, both neighbourhoods."""
    rng = np.random.default_rng(3)
    coords, cells, channels = [], [], []
    for name, side in (("a", 9), ("b", 10)):
        places = [(x, y) for y in range(side) for x in range(side) if rng.random() < 0.85]
        coords += [(name, 7 * k + 2, x, y) for k, (x, y) in enumerate(places)]
        for c in range(7):
            channels.append((name, c, 100.0 + c, 0.5, 10))
            for k, (x, y) in enumerate(places):
                v = [1.0, float(rng.random()), float(x + rng.random()), 5.0 * (x < 4), float(rng.random() < 0.1), 0.0, float((x + y) % 2)][c]
                if v > 0:
                    cells.append((name, 7 * k + 2, c, v))
    pixels, _ = M.pixels_of(spark.createDataFrame(coords, "dataset_id string, pixel_id long, x int, y int"))
    cells = spark.createDataFrame(cells, "dataset_id string, pixel_id long, channel int, intensity double")
    channels = spark.createDataFrame(channels, "dataset_id string, channel int, mz double, prevalence double, n_peaks long")
    for side in ("queen", "rook"):
        p = moran.MoranParams(n_permutations=30, neighborhood=side)
        test = lambda: [(r.dataset_id, r.channel, round(r.p, 9), round(r.i, 9)) for r in moran.moran_test(cells, channels, pixels, p, 5).orderBy("dataset_id", "channel").collect()]  # noqa: E731, B023
        with monkeypatch.context() as m:
            m.setattr(moran, "IMAGE_PIXELS", 0)
            rows = test()
        with monkeypatch.context() as m:
            m.setattr(moran, "REPS", 8)
            m.setattr(moran, "VALUES", 200)
            assert test() == rows
        assert test() == rows and rows[0][3] == 0 and rows[3][2] < 0.05 < rows[1][2]


def test_histogram_bins_are_exact(spark):
    """Every integer of every range in its own bin, and values on the edges of fixed bins where numpy has them."""
    for span in (1, 2, 7, 49, 92, 93, 147, 200):
        v = spark.range(span + 1).select(F.col("id").cast("double").alias("v"))
        assert [r.n for r in views.histogram(v, "v", "integer").orderBy("bin").collect()] == [1] * (span + 1), span
    for lo, hi, k in ((0.1, 0.7, 6), (-3.3, 9.9, 12), (1.0, 93.0, 46), (0.3, 4.2, 13)):
        values = list(np.linspace(lo, hi, k + 1)) + list(np.linspace(lo, hi, 3 * k + 1))
        h = views.histogram(spark.createDataFrame([(float(x),) for x in values], "v double"), "v", k).orderBy("bin").collect()
        assert [r.n for r in h] == list(np.histogram(values, k)[0]) and [r.left for r in h] == pytest.approx(list(np.linspace(lo, hi, k + 1)[:-1]))


def test_imzml_round_trip(spark, ds, aligned, tmp_path):
    path = f"{tmp_path}/x.imzML"
    imzml.write_imzml(ds, path)
    back = imzml.read_imzml(spark, f"{tmp_path}/x.ibd")
    a = sorted((r.pixel_id, r.mz, np.float32(r.intensity)) for r in ds.peaks.collect())
    b = sorted((r.pixel_id, r.mz, np.float32(r.intensity)) for r in back.peaks.collect())
    assert a == b and back.grid_shape == (5, 5) and back.metadata.ionization == "maldi" and back.metadata.polarity == "negative" and back.sources["polarity"] == "imzml"
    assert back.metadata.pixel_size_um == 50.0 and back.metadata.mz_min == pytest.approx(200, rel=1e-4)
    imzml.write_imzml(aligned, f"{tmp_path}/m.imzML")
    m = imzml.read_imzml(spark, f"{tmp_path}/m.imzML")
    assert m.is_matrix and m.cells.count() == 125 and m.channels.count() == 5
    os.remove(f"{tmp_path}/m{imzml.AXIS_ENDING}")
    with pytest.warns(UserWarning):
        assert not imzml.read_imzml(spark, f"{tmp_path}/m.imzML").is_matrix
    with open(f"{tmp_path}/x.ibd", "ab") as f:
        f.write(b"!")
    with pytest.warns(UserWarning):
        imzml.read_imzml(spark, path)


def cdf(path, n, shift=0.0, seed=0, attrs=None):
    rng = np.random.default_rng(seed)
    mz = np.concatenate([np.array([200.0, 300.0, 400.0, 500.0]) * (1 + rng.normal(0, 5e-6, 4)) + shift for _ in range(n)])
    netcdf3.write(path, {
        "scan_index": ("scan_number", np.arange(n, dtype="i4") * 4), "point_count": ("scan_number", np.full(n, 4, "i4")),
        "mass_values": ("point_number", mz), "intensity_values": ("point_number", rng.integers(950, 1050, 4 * n).astype("i4")),
    }, {"test_ionization_mode": "Electrospray Ionization", "test_ionization_polarity": "Negative Polarity", "experiment_type": "Centroided Mass Spectrum"} | (attrs or {}))


def test_cdf(spark, tmp_path):
    cdf(f"{tmp_path}/run.cdf", 5)
    with pytest.warns(UserWarning):
        d = load.load(spark, f"{tmp_path}/run.cdf")
    assert d.grid_shape == (1, 5) and d.peaks.count() == 20 and d.metadata.ionization == "esi" and d.metadata.polarity == "negative" and d.metadata.profile_or_centroided == "centroided"
    os.mkdir(f"{tmp_path}/img")
    for i in (10, 2, 1, 3):
        cdf(f"{tmp_path}/img/line-{i}.cdf", 6 + (i == 2), 0.001 * i, i)
    lay = andi.infer_layout(f"{tmp_path}/img")
    assert [os.path.basename(f) for f in lay.files] == [f"line-{i}.cdf" for i in (1, 2, 3, 10)]
    with pytest.warns(UserWarning):
        d = load.load(spark, f"{tmp_path}/img")
    assert d.grid_shape == (4, 6) and d.peaks.count() == 96 and d.metadata.ionization == "desi"
    s = andi.read_cdf_image(spark, f"{tmp_path}/img", dataclasses.replace(lay, serpentine=True))
    first = lambda q, px: q.peaks.where(F.col("pixel_id") == px).agg(F.min("mz")).first()[0]
    assert first(s, 6) == first(d, 11) and first(s, 0) == first(d, 0)


def test_sidecar_spec_tiff(spark, aligned, tmp_path):
    (tmp_path / "a.metadata.json").write_text(json.dumps({"polarity": "negative", "mz_max": 900, "mz_min": 100, "unknown": 1}))
    ep, where = sidecar.experiment({"polarity": "positive"}, "imzml", [f"{tmp_path}/a"])
    assert ep.polarity == "negative" and where["polarity"] == "sidecar" and ep.mz_max == 900.0
    p = pipeline.recommend(ep, rng_seed=3)
    spec.write(f"{tmp_path}/p.spec.xml", p, ep, diagnostics={"ref": {"x": math.inf, "y": math.nan}})
    s = spec.read(f"{tmp_path}/p.spec.xml")
    assert s.pipeline.nodes == p.nodes and s.pipeline.rng_seed == 3 and s.experiment["polarity"] == "negative"
    assert s.diagnostics["ref"]["x"] == math.inf and math.isnan(s.diagnostics["ref"]["y"])
    tiff.write_tiff(aligned, f"{tmp_path}/t.tiff")
    pages = tiff.pages(f"{tmp_path}/t.tiff")
    assert len(pages) == 5 and pages[0][0].shape == (5, 5) and json.loads(pages[2][1])["page"] == 2
    assert pages[0][0].sum() == pytest.approx(aligned.cells.where("channel = 0").agg(F.sum("intensity")).first()[0], rel=1e-5)
    assert (tmp_path / "t.csv").read_text().startswith("page,mz,prevalence") and tiff.page_metadata(f"{tmp_path}/t.tiff")[1]["mz"] == pytest.approx(250, rel=1e-4)


def test_command_lines(spark, ds, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    for i in (0, 1):
        imzml.write_imzml(synthetic(spark, seed=i), f"{tmp_path}/in/s{i}.imzML")
    steps = [("norm", "median_normalize"), ("cons", "kde_consensus_alignment")]
    p = pipeline.chain(ds.metadata, steps, 0).replace("cons", params=consensus.KdeParams(n_grid_points=8192, bandwidth_ppm=50.0, default_tol_ppm=200.0))
    spec.write(f"{tmp_path}/p.spec.xml", p, ds.metadata)
    assert apply_spec.main([f"{tmp_path}/in/s0.imzML", f"{tmp_path}/p.spec.xml", "-o", f"{tmp_path}/out"], spark) == 0
    assert {"s0_processed.tiff", "s0_processed.csv", "s0_processed.imzML", "s0_processed.ibd", "s0_processed.spec.xml"} <= set(os.listdir(f"{tmp_path}/out"))
    assert apply_spec.main([f"{tmp_path}/none.imzML", f"{tmp_path}/p.spec.xml"], spark) == 2
    assert cohort_align.main([f"{tmp_path}/in", "-o", f"{tmp_path}/co", "--no-imzml", "--bandwidth-ppm", "20"], spark) == 0
    told = json.load(open(f"{tmp_path}/co/cohort_summary.json"))
    assert set(told) == {"n_datasets", "shared_consensus_mz", "cohort_prevalence", "per_dataset_prevalence", "datasets", "diagnostics", "params"}
    n = len(told["shared_consensus_mz"])
    assert told["n_datasets"] == len(told["datasets"]) == len(told["per_dataset_prevalence"]) and n >= 5 and len(told["cohort_prevalence"]) == n
    assert told["datasets"][0]["n_pixels"] == 25 and told["datasets"][0]["grid_shape"] == [5, 5] and told["datasets"][0]["mode"] == "centroided"
    assert told["diagnostics"]["n_consensus_shared"] == n and told["diagnostics"]["n_total_pixels"] == 25 * told["n_datasets"] and told["diagnostics"]["cohort_prevalence_max"] == max(told["cohort_prevalence"])
    assert told["params"]["bandwidth_ppm"] == 20.0 and told["params"]["rng_seed"] == 0
    pages = [tiff.page_metadata(f"{tmp_path}/co/{f}") for f in sorted(os.listdir(f"{tmp_path}/co")) if f.endswith(".tiff")]
    assert all([p["cohort_prevalence"] for p in one] == pytest.approx(told["cohort_prevalence"]) for one in pages)
    assert cohort_align.main([f"{tmp_path}/co"], spark) == 2


def test_streaming_ingest(spark, ds, tmp_path):
    from ionweave.streaming import ingest

    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    ds.peaks.where("pixel_id < 10").write.parquet(src)
    got = ingest.latest_tic(spark, src, out, f"{tmp_path}/c")
    assert got.count() == 10
    ds.peaks.write.mode("append").parquet(src)
    got = {r.pixel_id: r.peaks for r in ingest.latest_tic(spark, src, out, f"{tmp_path}/c").collect()}
    assert got[0] == 10 and got[20] == 5
    ingest.ingest(spark, src, f"{tmp_path}/t", f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 175


def test_instrument_by_names_of_terms():
    from ionweave.sources.imzml import NAME, metadata

    family = lambda *terms: metadata({t if ":1" in t else NAME + t.lower(): [] for t in terms}).get("instrument_family")
    assert family("MS:1000084") == family("Time-of-flight") == "tof_axial"
    assert family("MS:1000084", "quadrupole time-of-flight") == family("MS:1000084", "a Q-TOF of some kind") == "qtof"
    assert family("MS:1000084", "reflectron on") == family("MS:1000084", "Bruker Daltonics flex series") == "tof_reflectron"
    assert family("LTQ Orbitrap", "MS:1000084") == "orbitrap" and family("FT-ICR") == "fticr" and family("x") is None
    assert metadata({NAME + "desorption electrospray ionization": [], NAME + "profile spectrum": [], NAME + "negative scan": []}) == {"ionization": "desi", "profile_or_centroided": "profile", "polarity": "negative"}


def test_saved_dataset(spark, tmp_path):
    from ionweave.catalog import cells_dataset
    from ionweave.model import DatasetIdentity, OpRecord, RoiDef
    from ionweave.sources import load, native

    ds = cells_dataset(spark, "/root/testdata/sf0.001").with_(identity=DatasetIdentity("a", "b", None, (("k", "v"),)), rng_seed=5)
    ds = ds.with_rois(RoiDef("r", ((0.0, 0.0), (0.0, 2.5), (2.5, 2.5)), True)).with_history(OpRecord("op", "p", "i", "o", (("n", 1.0),))).with_extras(more=ds.channels.select("dataset_id", "channel"))
    native.write(ds, f"{tmp_path}/saved")
    got = load.load(spark, f"{tmp_path}/saved")
    for name in ("metadata", "identity", "history", "rois", "rng_seed", "grid_shape"):
        assert getattr(got, name) == getattr(ds, name), name
    assert got.hash() == ds.hash() and got.peaks is None and set(got.extras) == {"more"}
    for name in ("pixels", "cells", "channels"):
        a, b = getattr(got, name), getattr(ds, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_bins_and_union(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = views.histogram(df, "x", "sqrt").orderBy("bin").collect()
    assert [r.n for r in h] == list(np.histogram(x, bins=22)[0]) and h[0].left == pytest.approx(x.min())
    k = rng.integers(3, 12, 300)
    h = views.histogram(spark.createDataFrame([(int(v),) for v in k], "x long"), "x", "integer").orderBy("bin").collect()
    assert [r.n for r in h] == list(np.histogram(k, np.arange(k.min(), k.max() + 2))[0]) and h[0].left == k.min()
    c = {r.value: r.share for r in views.cdf(df, "x").collect()}
    assert c == {v: pytest.approx((x <= v).mean()) for v in x}
    assert [r.mz for r in views.plotted_mz(spark.createDataFrame([(2.0,), (1.0,)], "mz double"), spark.createDataFrame([(2.0,), (None,)], "mz double")).collect()] == [1.0, 2.0]


def test_growing_cohort_is_a_full_run(spark, tmp_path):
    """Datasets added one by one, one of them twice, give what a run over all gives; a dataset whose writer died isn't there."""
    parts = [cohort.with_id(synthetic(spark, seed=k), n) for k, n in enumerate("xyz")]
    p = cohort.CohortParams(bandwidth_ppm=20.0, bootstrap_B=3)
    c = cohort.GrowingCohort(spark, f"file://{tmp_path}/c", p)
    show = lambda r: (sorted(map(tuple, r.prevalence.collect())), sorted(map(tuple, r.per_dataset.collect())), sorted(tuple(x) for x in r.dataset.cells.select("dataset_id", "pixel_id", "channel", "intensity").collect()), r.diagnostics.first().asDict())
    c.add(parts[0])
    c.add(cohort.with_id(synthetic(spark, seed=9), "y"))
    assert show(c.align())[3]["n_datasets"] == 2
    c.add(parts[1])  # the right one takes the place of the other
    c.add(parts[2])
    (tmp_path / "c" / "peaks" / "dataset_id=w").mkdir()
    full = show(cohort.align_cohort(cohort.union(parts), p))
    grown = show(c.align())
    for a, b in zip(grown, full, strict=True):
        assert a == pytest.approx(b) if isinstance(a, dict) else len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def test_formats_and_advice_of_keys():
    shown = diagnostics.shown
    assert [shown("inliers_median", 4.25), shown("improvement_ppm", 3.14159), shown("factor_q25", 0.000123456), shown("bandwidth_log_mz", 5e-5)] == ["4.2", "+3.14", "0.0001235", "5.00e-05"]
    assert [shown("n_channels_out", 12.0), shown("prevalence_max", 0.5), shown("min_snr", 3.0), shown("unknown", 1234.567), shown("alpha", math.nan)] == ["12", "0.500", "3.0", "1235", "-"]
    advice = diagnostics.advice
    assert advice("n_reference_ions", "warn") != advice("n_reference_ions", "bad") and advice("n_reference_ions", "ok") == ""
    assert advice("warning_flat_tolerance", "bad") == advice("warning_flat_tolerance", "warn") != "" and advice("unknown", "bad") == ""
    assert set(diagnostics.ADVICE) == set(diagnostics.LIMITS) <= set(diagnostics.FORMATS)


def test_operators_emit_the_graded_keys(spark, with_refs, aligned):
    """Every key with limits is emitted by some operator or the cohort."""
    values = {}
    for op, d, p in (
        ("detect_reference_ions", with_refs, None), ("empirical_tolerance_from_reference_ions", with_refs, tolerance.ToleranceParams(bootstrap_B=5)), ("msiwarp_recalibrate", with_refs, None), ("lock_mass_recalibrate", with_refs, None),
        ("median_normalize", with_refs, None), ("reference_ion_normalize", with_refs, None), ("snr_peak_pick", with_refs, pick.SnrParams(snr_mad=0.5)), ("kde_consensus_alignment", with_refs, consensus.KdeParams(bandwidth_ppm=20.0, default_tol_ppm=200.0)),
        ("dbscan_consensus", with_refs, dbscan.DbscanParams(100.0, 3)), ("morans_i_permutation", aligned, None), ("prevalence_fdr_filter", aligned, None), ("hot_pixel_filter", with_refs, None),
    ):
        got = operator(op).apply(d, p).diagnostics[0].values()
        assert all(isinstance(v, float) for v in got.values()) and len(got) >= 5, op
        values |= got
    few = with_refs.with_extras(ref_ions=with_refs.extras["ref_ions"].limit(2), ref_obs=with_refs.extras["ref_obs"].where("ref_id < 2"))
    assert operator("empirical_tolerance_from_reference_ions").apply(few, tolerance.ToleranceParams(bootstrap_B=5)).diagnostics[0].values()["warning_flat_tolerance"] == 1.0
    assert values["warning_flat_tolerance"] == 0.0 and values["improvement_ppm"] == pytest.approx(values["pre_residual_median_ppm"] - values["post_residual_median_ppm"]) and values["kept_per_pixel_max"] >= values["kept_per_pixel_min"]
    union = cohort.union([cohort.with_id(with_refs, n) for n in "xy"])
    r = cohort.align_cohort(union, cohort.CohortParams(bandwidth_ppm=20.0, bootstrap_B=3))
    values |= r.diagnostics.first().asDict()
    assert values["n_datasets"] == 2 and values["n_total_pixels"] == 50 and values["n_consensus_shared"] == r.axis.count()
    assert set(diagnostics.LIMITS) <= set(values)


def test_grades_of_all_ways():
    grades = lambda key, *vs: [diagnostics.grade(key, v) for v in vs]
    assert grades("fraction_hot", 0.05, 0.1, 0.15, 0.2) == ["ok", "warn", "warn", "bad"]
    assert grades("improvement_ppm", 0.1, 0.0) == ["ok", "bad"] and grades("factor_min", 1.0, 0.0) == ["", "bad"]
    assert grades("warning_flat_tolerance", 0.0, 1.0) == ["", "bad"] and grades("cohort_prevalence_median", 0.4, 0.3, 0.1) == ["ok", "warn", "bad"]
    assert diagnostics.shown("fraction_kept", 0.25) == "25.0%" and diagnostics.shown("p_value_min", 0.00123) == "0.0012" and diagnostics.shown("n_pixels", 7.0) == "7" and diagnostics.shown("ppm_shift_median", 3.0) == "+3.00"


def test_prevalence_draws_shuffle_bits(spark, monkeypatch):
    """Draws by more than one row and task equal plain ones, and no row for each ball is shuffled."""
    import hashlib

    monkeypatch.setattr(prevalence, "THROWS", 20_000, raising=False)
    monkeypatch.setattr(prevalence, "STEP", 999, raising=False)
    balls, n, draws = {0: 50_000, 1: 1, 2: 0}, 60_000, 2
    c = spark.createDataFrame([("a", k, n, 33_900 if k == 0 else 1, b) for k, b in balls.items()], "dataset_id string, channel int, n_pixels long, obs long, balls long")
    full = lambda k, r: len({int(hashlib.md5(f"7|{r}|{k}|{b}".encode()).hexdigest()[:8], 16) % n for b in range(1, balls[k] + 1)})
    want = {0: (sum(full(0, r) >= 33_900 for r in range(draws)) + 1) / (draws + 1), 1: 1.0, 2: 1.0}
    got = prevalence.p_draws(c, draws, 7)
    spark.sparkContext.setJobGroup("draws", "draws")
    try:
        assert {r.channel: r.p for r in got.collect()} == pytest.approx(want)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = [s for j in tracker.getJobIdsForGroup("draws") for s in tracker.getJobInfo(j).stageIds]
    assert max(store.lastStageAttempt(s).shuffleWriteRecords() for s in set(stages)) < 5_000


def test_strongest_of_bins_hashes_numbers(spark, monkeypatch):
    """The aggregation that reads all peaks is one of numbers by hash, without a sort; ties, also of bins without
    a number and of intensities that are null or no numbers, go as before."""
    plans, hold = [], reference_ions.hold if hasattr(reference_ions, "hold") else M.hold
    monkeypatch.setattr(reference_ions, "hold", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or hold(df))
    nan = float("nan")
    rows = [("a", 1, 5, 200.0, 9.0), ("a", 1, 3, 200.0, 9.0), ("a", 1, 3, 199.999, 9.0), ("a", 1, 2, 200.0, 8.0), ("a", 2, 4, 300.0, None), ("a", 2, 1, 300.0, None), ("a", 3, 7, 300.0, nan), ("a", 3, 6, 300.0, 5.0), ("a", 4, 2, -1.0, 1.0), ("a", 4, 1, -1.0, 1.0)]
    got = reference_ions.best_of_bins(spark.createDataFrame(rows, M.PEAKS), 5000.0).collect()
    assert sorted((r.pixel_id, r.peak_idx, r.mz, str(r.intensity)) for r in got) == [(1, 3, 199.999, "9.0"), (2, 1, 300.0, "None"), (3, 7, 300.0, "nan"), (4, 1, -1.0, "1.0")]
    assert len(plans) == 1 and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]

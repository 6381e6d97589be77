"""The imzML source and writer: ranges, push-down, both layouts, prefix sums, awkward files."""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave import model as M
from ionweave.sources import files, imzml, ranges, spectra
from ionweave.testdata import peaks_dataset

SMALL = "/root/testdata/sf0.001"
HEAD = """<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><fileDescription><fileContent><cvParam accession="IMS:1000030" name="continuous" value=""/></fileContent></fileDescription>
<referenceableParamGroupList><referenceableParamGroup id="m"><cvParam accession="MS:1000514" name="m/z array" value=""/><cvParam accession="MS:1000521" name="32-bit float" value=""/></referenceableParamGroup>
<referenceableParamGroup id="i"><cvParam accession="MS:1000515" name="intensity array" value=""/><cvParam accession="MS:1000519" name="32-bit integer" value=""/></referenceableParamGroup></referenceableParamGroupList>
<run id="r"><spectrumList count="{n}">"""
ONE = """<spectrum id="s{k}" index="{k}"><cvParam accession="MS:1000129" name="negative scan" value=""/><cvParam accession="MS:1000528" name="lowest observed m/z" value="{lo}"/><cvParam accession="MS:1000527" name="highest observed m/z" value="{hi}"/>
<scanList><scan><cvParam accession="MS:1000512" name="filter of an Orbitrap &lt;x&gt;" value="1"/><cvParam accession="IMS:1000050" name="position x" value="{x}"/><cvParam accession="IMS:1000051" name="position y" value="{y}"/></scan></scanList>
<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>"""
ARRAY = '<binaryDataArray><referenceableParamGroupRef ref="{g}"/><cvParam accession="IMS:1000103" name="external array length" value="{n}"/><cvParam accession="IMS:1000102" name="external offset" value="{at}"/><binary/></binaryDataArray>'


def continuous(folder, width, height, n_mz):
    """A file of another writer: one m/z array for all, 32-bit values, intensities before m/z in the index."""
    rng = np.random.default_rng(1)
    mz = np.sort(rng.uniform(100, 900, n_mz)).astype("<f4")
    inten = rng.integers(0, 1000, (width * height, n_mz)).astype("<i4")
    with open(f"{folder}/c.ibd", "wb") as f:
        f.write(b"\1" * 16 + mz.tobytes() + inten.tobytes())
    with open(f"{folder}/c.imzML", "w") as f:
        f.write(HEAD.format(n=width * height))
        for k in range(width * height):
            arrays = ARRAY.format(g="i", n=n_mz, at=16 + 4 * n_mz * (1 + k)) + ARRAY.format(g="m", n=n_mz, at=16)
            f.write(ONE.format(k=k, lo=100 + k, hi=800 + k, x=k % width + 1, y=k // width + 1, arrays=arrays))
        f.write("</spectrumList></run></mzML>")
    return mz, inten


def test_other_layout(spark, tmp_path):
    mz, inten = continuous(tmp_path, 7, 5, 40)
    ds = imzml.read_imzml(spark, f"{tmp_path}/c.imzML")
    assert ds.grid_shape == (5, 7) and ds.metadata.polarity == "negative" and ds.metadata.instrument_family == "orbitrap"
    assert (ds.metadata.mz_min, ds.metadata.mz_max) == (100.0, 834.0)
    got = sorted((r.pixel_id, r.peak_idx, r.mz, r.intensity) for r in ds.peaks.collect())
    assert got == [(k, j, float(mz[j]), float(inten[k, j])) for k in range(35) for j in range(40)]
    assert [tuple(r) for r in ds.pixels.orderBy("pixel_id").select("pixel_id", "x", "y").collect()] == [(k, k % 7 + 1, k // 7 + 1) for k in range(35)]
    # The same by an address.
    assert imzml.read_imzml(spark, f"file://{tmp_path}/c.ibd").peaks.count() == 35 * 40


def test_ranges():
    at = lambda first, stop: [(p.first, p.stop) for p in spectra.SpectraReader({"ibd": "x", "index": "y", "first": str(first), "stop": str(stop), "dataset_id": "a"}).partitions()]
    assert at(0, 5000) == [(0, 2048), (2048, 4096), (4096, 5000)]
    assert at(3000, 3500) == [(3000, 3500)] and at(7, 7) == at(9, 3) == [(0, 0)]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pair")
    ds = peaks_dataset(spark, SMALL)
    imzml.write_imzml(ds, f"{folder}/p.imzML")
    return ds, imzml.read_imzml(spark, f"{folder}/p.imzML"), folder


def numbered(df):
    return sorted((r.pixel_id, r.mz, float(np.float32(r.intensity))) for r in df.collect())


def test_round_trip_and_ranges(spark, pair, monkeypatch):
    ds, back, folder = pair
    assert numbered(back.peaks) == numbered(ds.peaks) and back.grid_shape == ds.grid_shape
    assert back.pixels.select("pixel_id", "gx", "gy").exceptAll(ds.pixels.select("pixel_id", "gx", "gy")).isEmpty() and back.pixels.count() == 256
    for where in ("pixel_id = 17", "pixel_id BETWEEN 30 AND 40 AND mz < 500", "pixel_id IN (3, 99, 255, 1000)", "pixel_id > 250"):
        assert numbered(back.peaks.where(where)) == numbered(ds.peaks.where(where)), where
    # A query with a filter leaves later ones on the same table alone.
    assert back.peaks.count() == ds.peaks.count()
    for first, stop in ((30, 41), (250, 9999), (-5, 3), (40, 40)):
        part = imzml.read_imzml(spark, f"{folder}/p.imzML", pixels=(first, stop))
        inside = F.col("pixel_id").between(first, stop - 1)
        assert numbered(part.peaks) == numbered(ds.peaks.where(inside)) and part.pixels.count() == ds.pixels.where(inside).count()
    # Bytes outside a range's spectra aren't read.
    shorter = f"{folder}/q.imzML"
    for ending in ("imzML", "ibd"):
        (folder / f"q.{ending}").write_bytes((folder / f"p.{ending}").read_bytes())
    os.truncate(f"{folder}/q.ibd", 40_000)
    with pytest.warns(UserWarning):
        assert numbered(imzml.read_imzml(spark, shorter, pixels=(0, 50)).peaks) == numbered(ds.peaks.where("pixel_id < 50"))


def test_files_are_those_of_one_serial_writer(pair):
    """Offsets follow one another without a gap, and the digest is that of the file."""
    _, back, folder = pair
    raw = (folder / "p.ibd").read_bytes()
    text = (folder / "p.imzML").read_text()
    assert hashlib.md5(raw).hexdigest() in text and len(raw) == 16 + 12 * back.peaks.count()
    index = imzml.index_table(back.pixels.sparkSession, f"file://{folder}/p.imzML", imzml.parse_header(f"{folder}/p.imzML")[0]).orderBy("pixel_id").collect()
    at = 16
    for k, r in enumerate(index):
        assert (r.pixel_id, r.mo, r.io, r.ml, r.mt, r["it"]) == (k, at, at + 8 * r.ml, r.il, "<f8", "<f4")
        at += 12 * r.ml
    assert at == len(raw) and not [f for f in os.listdir(folder) if f.endswith(".part")]
    assert struct.unpack_from("<d", raw, 16)[0] == back.peaks.where("pixel_id = 0 AND peak_idx = 0").first().mz


def test_prefix_sums_over_parts(spark, monkeypatch):
    monkeypatch.setattr(imzml, "PART", 3)
    ids = [0, 1, 2, 3, 7, 8, 9, 30, 31, 1000]
    rows = spark.createDataFrame([(p, 10 * k + 1) for k, p in enumerate(ids)], "pixel_id long, n long").repartition(4)
    got = imzml.before(rows, {"k": F.lit(1), "s": F.col("n")}).orderBy("pixel_id").collect()
    assert [(r.pixel_id, r.k, r.s) for r in got] == [(p, k, sum(10 * j + 1 for j in range(k))) for k, p in enumerate(ids)]


def test_sparse_pixels_small_batches(spark, tmp_path, monkeypatch):
    """Pixel numbers with holes are renumbered in order; small reads and parts change nothing."""
    monkeypatch.setattr(imzml, "PART", 4)
    coords = [("a", p, p % 10 + 1, p // 10 + 1) for p in (3, 4, 50, 51, 99)]
    rows = [("a", p, j, 100.0 + p + j, float(j)) for p in (3, 50, 99) for j in range(p % 7)]
    pixels, shape = M.pixels_of(spark.createDataFrame(coords, "dataset_id string, pixel_id long, x int, y int"), (10, 10))
    ds = M.MsiDataset(pixels, peaks=spark.createDataFrame(rows, M.PEAKS), grid_shape=shape)
    imzml.write_imzml(ds, f"{tmp_path}/s.imzML")
    back = imzml.read_imzml(spark, f"{tmp_path}/s.imzML")
    order = {p: k for k, p in enumerate((3, 4, 50, 51, 99))}
    assert numbered(back.peaks) == sorted((order[p], m, i) for _, p, _, m, i in rows)
    assert back.grid_shape == (10, 10)


def test_empty_dataset(spark, tmp_path):
    pixels, shape = M.pixels_of(spark.createDataFrame([], "dataset_id string, pixel_id long, x int, y int"))
    imzml.write_imzml(M.MsiDataset(pixels, peaks=spark.createDataFrame([], M.PEAKS), grid_shape=shape), f"{tmp_path}/e.imzML")
    back = imzml.read_imzml(spark, f"{tmp_path}/e.imzML")
    assert back.pixels.count() == back.peaks.count() == 0


def test_broken_files(spark, tmp_path):
    continuous(tmp_path, 3, 3, 20)
    os.truncate(f"{tmp_path}/c.ibd", 500)
    with pytest.raises(Exception, match="ends within the spectrum"):
        imzml.read_imzml(spark, f"{tmp_path}/c.imzML").peaks.count()
    text = (tmp_path / "c.imzML").read_text()
    (tmp_path / "c.imzML").write_text(text.replace('name="position x" value="2"', 'name="position x" value=""', 1))
    with pytest.raises(ValueError, match="1 spectra"):
        imzml.read_imzml(spark, f"{tmp_path}/c.imzML")
    with pytest.raises(FileNotFoundError):
        imzml.pair(f"{tmp_path}/none.imzML")


def test_writes_of_a_second_attempt(tmp_path):
    path = f"{tmp_path}/x"
    open(path, "wb").write(b"." * 10)
    for _ in range(2):  # the first attempt died after its writes
        out = ranges.Places(path)
        for at, data in ((2, b"ab"), (4, b"cd"), (8, b"e")):
            out.put(at, data)
        assert out.close() == 5
    assert open(path, "rb").read() == b"..abcd..e."
    w = spectra.RangesWriter({"ibd": path, "xml": path + "2", "bytes": "6"})
    with pytest.raises(RuntimeError):
        w.commit([ranges.Written(5), None])
    w.abort([None])
    assert not os.path.exists(path)
    with pytest.raises(ValueError, match="mounted"):
        files.mounted("mock://x/y")


def test_many_spectra_stay_off_the_driver(spark, tmp_path):
    """The driver gets terms and bounds of an index, whatever its number of rows."""
    continuous(tmp_path, 100, 100, 2)
    ds = imzml.read_imzml(spark, f"{tmp_path}/c.imzML")
    assert ds.pixels.count() == 10_000 and ds.peaks.count() == 20_000 and ds.peaks.rdd.getNumPartitions() == 5
    one = imzml.spectrum_terms(imzml.index_table(spark, f"file://{tmp_path}/c.imzML", {}))
    assert len(one) < 20 and one["MS:1000528"] == ["100.0", "10099.0"]

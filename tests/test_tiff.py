"""TIFF files by strips: shapes, strips of one and many rows, both sizes of places, empty channels, texts."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave import model as M
from ionweave.sources import tiff


def images(spark, h, w, n, seed=0):
    rng = np.random.default_rng(seed)
    img = np.where(rng.random((n, h, w)) < 0.4, rng.uniform(0, 1e4, (n, h, w)), 0).astype("<f4")
    img[n // 2] = 0  # a channel without a cell
    pixels, shape = M.pixels_of(spark.createDataFrame([("a", y * w + x, x, y) for y in range(h) for x in range(w)], "dataset_id string, pixel_id long, x int, y int"), (h, w))
    cells = [("a", y * w + x, c, float(img[c, y, x])) for c in range(n) for y in range(h) for x in range(w) if img[c, y, x]]
    channels = [("a", c, 100.0 + c, None if c == 1 else float((img[c] > 0).mean()), 3) for c in range(n)]
    return img, M.MsiDataset(pixels, cells=spark.createDataFrame(cells, "dataset_id string, pixel_id long, channel int, intensity double"), channels=spark.createDataFrame(channels, "dataset_id string, channel int, mz double, prevalence double, n_peaks long"), grid_shape=shape)


@pytest.mark.parametrize("big, compress, strip", [(None, True, 1 << 18), (False, True, 20), (True, True, 20), (True, False, 7), (False, False, 1)])
def test_pages(spark, tmp_path, monkeypatch, big, compress, strip):
    monkeypatch.setattr(tiff, "STRIP", strip)
    monkeypatch.setattr(tiff, "BATCH", 3)
    img, ds = images(spark, 11, 7, 6)
    path = f"{tmp_path}/x.tiff"
    extra = spark.createDataFrame([(c, f"Ä {c}") for c in range(6)], "channel int, name string")
    tiff.write_tiff(ds, path, compress=compress, big=big, extra=extra)
    raw = open(path, "rb").read()
    assert struct.unpack_from("<2sH", raw) == (b"II", 43 if big else 42) and not os.path.exists(path + ".part")
    got = tiff.pages(path)
    assert len(got) == 6 and all((a == b).all() for (a, _), b in zip(got, img, strict=True))
    notes = tiff.page_metadata(path)
    assert [n["page"] for n in notes] == list(range(6)) and notes[3]["name"] == "Ä 3" and notes[1]["prevalence"] is None and notes[5]["mz"] == 105.0
    # Pages follow one another without gaps: all of the file is used, but for bytes that make places even.
    d = tiff.directories(path)
    assert all(len(x["offsets"]) == -(-11 // max(1, strip // 7)) for x in d) and all(o % 2 == 0 for x in d for o in x["offsets"])
    cells = sorted((r.channel, r.grid_idx, r.intensity) for r in tiff.read_cells(spark, path).collect())
    assert cells == [(c, k, float(v)) for c in range(6) for k, v in enumerate(img[c].ravel()) if v]
    assert (tmp_path / "x.csv").read_text().splitlines()[0] == "page,mz,prevalence,name"


def test_no_channels_and_no_cells(spark, tmp_path):
    _, ds = images(spark, 4, 3, 2)
    none = ds.with_matrix(ds.cells.where("false"), ds.channels.where("false"))
    tiff.write_tiff(none, f"{tmp_path}/n.tiff")
    assert tiff.pages(f"{tmp_path}/n.tiff") == [] and tiff.read_cells(spark, f"{tmp_path}/n.tiff").count() == 0
    dark = ds.with_(cells=ds.cells.where(F.lit(False)))
    tiff.write_tiff(dark, f"{tmp_path}/d.tiff")
    assert [p.sum() for p, _ in tiff.pages(f"{tmp_path}/d.tiff")] == [0.0, 0.0]
    with pytest.raises(ValueError, match="mounted"):
        tiff.write_tiff(ds, "mock://bucket/x.tiff")

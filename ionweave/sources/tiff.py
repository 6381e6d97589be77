"""Multipage float TIFF of channel images, with a table of the channels.

A page is a channel's image in strips of some rows. Strips are made and compressed by tasks, keyed by page and
strip; their places, and those of the pages' directories, are prefix sums of their lengths; tasks write
their own ranges of the file. No image is ever one row. Files beyond 4 GB have 64-bit places.
"""

from __future__ import annotations

import csv
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MsiDataset, hold
from ..session import settings
from . import files, ranges

#: Values of a strip, and strips that a task handles at once.
STRIP, BATCH = 1 << 18, 16
#: Bytes up to which places have 32 bits.
SMALL = (1 << 32) - (1 << 20)
# Numbers of the format's tags, and its kinds of values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 339
TEXT, SHORT, LONG, LONG8 = 2, 3, 4, 16
DEFLATE = 8


class Layout:
    """How directories are packed, with places of 32 or 64 bits."""

    def __init__(self, big: bool) -> None:
        self.big, self.word, self.kind = big, 8 if big else 4, LONG8 if big else LONG
        self.head = 16 if big else 8
        self.entry, self.number, self.array = ("<HHQ", "<Q", "<Q") if big else ("<HHI", "<I", "<I")

    def header(self, first: int) -> bytes:
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if self.big else struct.pack("<2sHI", b"II", 42, first)

    def tail_size(self, n_strips: int, note: int) -> int:
        """Bytes of a page after its strips: its text, both arrays, its directory."""
        arrays = 2 * n_strips * self.word if n_strips > 1 else 0
        text = note + note % 2 if note > self.word else 0
        return text + arrays + (8 if self.big else 2) + 11 * (20 if self.big else 12) + self.word

    def directory_at(self, n_strips: int, note: int) -> int:
        """Where the directory begins in the tail."""
        return (note + note % 2 if note > self.word else 0) + (2 * n_strips * self.word if n_strips > 1 else 0)

    def tail(self, at: int, sizes: list[int], offsets: list[int], note: bytes, shape: tuple[int, int], rows: int, compress: bool, following: int) -> bytes:
        h, w = shape
        body = b""
        fit = lambda v, code: struct.pack(code, v).ljust(self.word, b"\0")

        def stored(raw: bytes) -> bytes:
            nonlocal body
            if len(raw) <= self.word:
                return raw.ljust(self.word, b"\0")
            place = at + len(body)
            body += raw + b"\0" * (len(raw) % 2)
            return struct.pack(self.number, place)

        text = stored(note)
        places = stored(struct.pack(f"<{len(offsets)}{self.array[1]}", *offsets))
        lengths = stored(struct.pack(f"<{len(sizes)}{self.array[1]}", *sizes))
        n = len(sizes)
        tags = [
            (WIDTH, LONG, 1, fit(w, "<I")), (LENGTH, LONG, 1, fit(h, "<I")), (BITS, SHORT, 1, fit(32, "<H")), (COMPRESSION, SHORT, 1, fit(DEFLATE if compress else 1, "<H")), (PHOTOMETRIC, SHORT, 1, fit(1, "<H")),
            (DESCRIPTION, TEXT, len(note), text), (STRIP_OFFSETS, self.kind, n, places), (SAMPLES, SHORT, 1, fit(1, "<H")), (ROWS_PER_STRIP, LONG, 1, fit(rows, "<I")), (STRIP_BYTES, self.kind, n, lengths), (SAMPLE_FORMAT, SHORT, 1, fit(3, "<H")),
        ]
        entries = b"".join(struct.pack(self.entry, k, kind, count) + value for k, kind, count, value in tags)
        return body + struct.pack("<Q" if self.big else "<H", len(tags)) + entries + struct.pack(self.number, following)


def directories(path: str) -> list[dict]:
    """(page, offsets, sizes, rows, height, width, deflated, note) of each page: only directories are read."""
    out = []
    with files.open_ranges(path) as f:
        head = f.read_at(16, 0)
        big = struct.unpack_from("<H", head, 2)[0] == 43
        lay = Layout(big)
        step, first = (20, 8) if big else (12, 2)
        at = struct.unpack_from(lay.number, head, 8 if big else 4)[0]
        while at:
            n = struct.unpack("<Q" if big else "<H", f.read_at(first, at))[0]
            entries = f.read_at(step * n + lay.word, at + first)
            tags = {}
            for i in range(n):
                k, kind, count = struct.unpack_from(lay.entry, entries, step * i)
                value = entries[step * (i + 1) - lay.word : step * (i + 1)]
                size = {TEXT: 1, SHORT: 2, LONG: 4, LONG8: 8}[kind] * count
                data = value[:size] if size <= lay.word else f.read_at(size, struct.unpack(lay.number, value)[0])
                tags[k] = data[:-1].decode() if kind == TEXT else list(struct.unpack(f"<{count}{ {SHORT: 'H', LONG: 'I', LONG8: 'Q'}[kind]}", data))
            one = lambda k: tags[k][0]  # noqa: B023, E731
            out.append({"page": len(out), "offsets": tags[STRIP_OFFSETS], "sizes": tags[STRIP_BYTES], "rows": one(ROWS_PER_STRIP), "height": one(LENGTH), "width": one(WIDTH), "deflated": one(COMPRESSION) == DEFLATE, "note": tags[DESCRIPTION]})
            at = struct.unpack_from(lay.number, entries, step * n)[0]
    return out


def _values(data: bytes, deflated: bool) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data) if deflated else data, "<f4")


def pages(path: str) -> list[tuple[np.ndarray, str]]:
    """(image, text) of every page, for small files."""
    with files.open_ranges(path) as f:
        return [(np.concatenate([_values(f.read_at(n, o), d["deflated"]) for o, n in zip(d["offsets"], d["sizes"], strict=True)]).reshape(d["height"], d["width"]), d["note"]) for d in directories(path)]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(channel, grid_idx, intensity) of all values but zeros; tasks read the strips."""
    index = spark.createDataFrame(directories(path), "page int, offsets array<long>, sizes array<long>, rows int, height int, width int, deflated boolean, note string")
    strips = index.select("page", "rows", "width", "deflated", F.posexplode(F.arrays_zip("offsets", "sizes")).alias("strip", "s")).select("page", (F.col("strip").cast("bigint") * F.col("rows") * F.col("width")).alias("start"), "deflated", "s.offsets", "s.sizes")

    def run(batches):
        with files.open_ranges(path) as f:
            for batch in batches:
                for page, start, deflated, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    v = _values(f.read_at(n, at), deflated)
                    k = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), page, np.int32)), pa.array(k + start), pa.array(v[k].astype(np.float64))], ["channel", "grid_idx", "intensity"])

    return strips.repartition("page", "start").mapInArrow(run, "channel int, grid_idx bigint, intensity double")


def page_metadata(path: str) -> list[dict]:
    return [json.loads(d["note"]) for d in directories(path)]


def _strips(ds: MsiDataset, rows: int, compress: bool) -> DataFrame:
    """(page, strip, data, size): all strips of all channels."""
    h, w = ds.grid_shape
    n_strips = -(-h // rows)
    every = ds.channels.select(F.col("channel").cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1))).alias("strip"))
    at = F.col("grid_idx")
    cells = ds.cells.join(ds.pixels.select("dataset_id", "pixel_id", "grid_idx"), ["dataset_id", "pixel_id"])
    cells = cells.select(F.col("channel").cast("int").alias("page"), F.floor(at / (rows * w)).cast("int").alias("strip"), (at % (rows * w)).cast("int").alias("k"), F.col("intensity").cast("float").alias("v"))
    lists = cells.groupBy("page", "strip").agg(F.collect_list("k").alias("k"), F.collect_list("v").alias("v"))  # the pixels of a strip, at most

    def make(batches):
        for batch in batches:
            out = []
            for strip, k, v in zip(batch.column("strip").to_pylist(), batch.column("k"), batch.column("v"), strict=True):
                img = np.zeros((min(h, (strip + 1) * rows) - strip * rows) * w, "<f4")
                if k.is_valid:
                    img[k.values.to_numpy()] = v.values.to_numpy()
                out.append(zlib.compress(img.tobytes()) if compress else img.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("strip"), pa.array(out, pa.binary()), pa.array(list(map(len, out)), pa.int64())], ["page", "strip", "data", "size"])

    return every.join(lists, ["page", "strip"], "left").mapInArrow(make, "page int, strip int, data binary, size bigint")


def write_tiff(ds: MsiDataset, path: str, *, compress: bool = True, write_csv: bool = True, extra: DataFrame | None = None, big: bool | None = None) -> None:
    """One page a channel, in channel order; ``extra`` (channel, ...) adds columns to pages and table. ``big``: places of
    64 bits, by the file's size if not said. The folder must be mounted by the driver and all executors."""
    path = files.mounted(path)
    ch = ds.channels.select("channel", "mz", "prevalence")
    ch = hold(ch.join(extra, "channel", "left") if extra is not None else ch)
    h, w = ds.grid_shape
    rows = max(1, STRIP // max(w, 1))
    with settings(ch.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        strips = hold(_strips(ds, rows, compress))
    note = F.to_json(F.struct(F.col("channel").alias("page"), *(c for c in ch.columns if c != "channel")), {"ignoreNullFields": "false"})
    sizes = strips.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("strip", "size"))), lambda s: s["size"]).alias("sizes"))
    table = ch.select(F.col("channel").cast("int").alias("page"), note.alias("note")).join(sizes, "page")
    padded = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, s: a + s + s % 2)
    total = table.agg(F.coalesce(F.sum(padded), F.lit(0))).first()[0]
    lay = Layout(total > SMALL if big is None else big)
    n_strips = -(-h // rows) if h else 0
    text = F.octet_length("note") + 1
    stored = F.when(text > lay.word, text + text % 2).otherwise(0)
    fixed = lay.tail_size(n_strips, 0)
    over = Window.orderBy("page")  # over pages: as many as there are channels
    table = table.withColumns({"strips": padded, "inner": stored + lay.directory_at(n_strips, 0)}).withColumn("size", F.col("strips") + stored + fixed)
    table = table.withColumn("at", F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + lay.head)
    table = hold(table.withColumn("ifd", F.col("at") + F.col("strips") + F.col("inner")).withColumn("following", F.coalesce(F.lead("ifd").over(over), F.lit(0))))

    def tails(batches):
        for batch in batches:
            ats, data = [], []
            for at, strips_, sizes_, note_, following in zip(*(batch.column(c).to_pylist() for c in ("at", "strips", "sizes", "note", "following")), strict=True):
                starts = np.cumsum([0, *(s + s % 2 for s in sizes_[:-1])]) + at
                ats.append(at + strips_)
                data.append(lay.tail(at + strips_, sizes_, starts.tolist(), note_.encode() + b"\0", (h, w), rows, compress, following))
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(data, pa.binary())], ["at", "data"])

    within = Window.partitionBy("page").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    placed = strips.select("page", "strip", F.coalesce(F.sum(F.col("size") + F.col("size") % 2).over(within), F.lit(0)).alias("in_page"), "data").join(table.select("page", "at"), "page")
    placed = placed.select((F.col("at") + F.col("in_page")).alias("at"), "data")
    first, end, written = table.agg(F.min("ifd"), F.max(F.col("at") + F.col("size")), F.sum(F.col("size") - F.col("strips") + F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, s: a + s))).first()
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(lay.header(first or 0))
        f.truncate(end or lay.head)
    ranges.write(placed.unionByName(table.mapInArrow(tails, "at bigint, data binary")), part, written or 0, BATCH)
    os.replace(part, path)
    if write_csv:
        listed = ch.orderBy("channel").collect()
        with open(path.rsplit(".", 1)[0] + ".csv", "w", newline="", encoding="utf-8") as f:
            names = list(ch.columns)
            t = csv.writer(f)
            t.writerow(["page" if n == "channel" else n for n in names])
            t.writerows([c[n] for n in names] for c in listed)
